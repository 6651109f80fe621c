"""Signal framing, quantisation and entropy coding as Spark jobs."""
