"""URL verdicts: host and path rules, and for the rest a ratio of two character language models.

URLs that a rule decides are the examples. Two variable-order Markov models (accepted, rejected), smoothed by
Witten and Bell's interpolation from the longest context that was seen down to none, are counted over all examples by Spark;
the number of n-grams is bounded by the alphabet, so the models are too. A URL's score is the difference of
its log-likelihoods a character; the threshold is the one of least balanced error on a held-out fifth of the examples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3  # characters of context
#: Fixed alphabet: a digit counts as 0, any other byte as "~"; first the end of a URL, last its beginning.
ALPHABET = "$abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%+~^"
SIZE = len(ALPHABET)
_CODES = np.full(256, ALPHABET.index("~"), np.int64)
for _i, _c in enumerate(ALPHABET[1:-1], 1):
    _CODES[ord(_c)] = _i
    _CODES[ord(_c.upper())] = _i
_CODES[ord("0") : ord("9") + 1] = ALPHABET.index("0")
_CODES[[ord("$"), ord("^")]] = ALPHABET.index("~")

BINS, SPAN = 4001, 4.0  # of the score histogram: -SPAN .. SPAN


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end. Both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. ``rules``: (verdict, host, path), a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def n_gram_codes(urls: list) -> tuple[np.ndarray, np.ndarray]:
    """(codes, edges): for each character of each URL and its end, the number of the (ORDER + 1)-gram that ends there."""
    raw = [b"" if u is None else u.encode("utf-8", "replace") for u in urls]
    edges = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    padded = np.concatenate([np.concatenate([np.full(ORDER, SIZE - 1), _CODES[np.frombuffer(r, np.uint8)], [0]]) for r in raw]) if raw else np.zeros(0, np.int64)
    codes = np.zeros(max(0, len(padded) - ORDER), np.int64)
    for k in range(ORDER + 1):
        codes = codes * SIZE + padded[k : len(padded) - ORDER + k]
    own = np.ones(len(codes), bool)  # n-grams that reach from one URL into the next don't count
    for e in (edges[1:-1] + ORDER * np.arange(1, len(raw))).tolist() if raw else []:  # where the next URL begins
        own[e - ORDER : e] = False
    return codes[own], edges


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log p(character | ORDER characters) of every (ORDER + 1)-gram from its counts, Witten-Bell smoothed."""
    p = np.full(SIZE, 1.0 / SIZE)
    for order in range(ORDER + 1):
        seen = counts.reshape(-1, SIZE**order, SIZE).sum(axis=0).astype(np.float64)  # by the last `order` characters
        total, kinds = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
        lower = np.tile(p.reshape(-1, SIZE), (seen.shape[0] // max(1, p.size // SIZE), 1))
        p = np.where(total > 0, (seen + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return np.log(p).astype(np.float32).reshape(-1)


def url_verdicts(pages: DataFrame, rules: list, *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """A row per row of ``pages``: page_id, host, path, rule, verdict, score (null where a rule decides).

    Null urls and those without ``://`` have an empty host and path and no rule; the models judge the empty
    URL or the whole string then. Of thresholds with equal errors the one nearest to zero counts. URLs count whole, however long. If the rules give no example of one kind, what they leave open is allowed. Repeated
    rows count as often as they stand. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    judged = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")).withColumns({"host": host, "path": path})
    judged = judged.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    examples = judged.where("by IS NOT NULL").select("url", (F.col("by.verdict") == "allow").alias("good"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held"))

    def count(iterator):
        tables = {}
        for batch in iterator:
            good = np.asarray(batch.column(1))
            for kind in (False, True):
                codes, _ = n_gram_codes(batch.column(0).filter(pa.array(good == kind)).to_pylist())
                tables[kind] = tables.get(kind, 0) + np.bincount(codes, minlength=SIZE ** (ORDER + 1))
        for kind, table in tables.items():
            found = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind)), pa.array(found.astype(np.int32)), pa.array(table[found])], names=["good", "code", "n"])

    # At most 2 * SIZE ** (ORDER + 1) sums, whatever the input.
    sums = examples.where("NOT held").select("url", "good").mapInArrow(count, "good boolean, code int, n long").groupBy("good", "code").agg(F.sum("n").alias("n")).toArrow()
    good, code, n = (sums[c].to_numpy() for c in ("good", "code", "n"))
    counts = np.zeros((2, SIZE ** (ORDER + 1)), np.int64)
    counts[good.astype(int), code] = n
    both = bool(counts[0].any() and counts[1].any())
    ratio = spark.sparkContext.broadcast(log_probabilities(counts[1]) - log_probabilities(counts[0]) if both else None)

    def scores(urls):
        codes, edges = n_gram_codes(urls)
        return np.add.reduceat(ratio.value[codes], edges[:-1]).astype(np.float64) / np.diff(edges) if len(urls) else np.zeros(0)

    def histogram(iterator):
        table = np.zeros((2, BINS), np.int64)
        for batch in iterator:
            place = np.clip(((scores(batch.column(0).to_pylist()) + SPAN) / (2 * SPAN) * (BINS - 1)).astype(int), 0, BINS - 1)
            np.add.at(table, (np.asarray(batch.column(1)).astype(int), place), 1)
        kind, place = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(kind == 1), pa.array(place.astype(np.int32)), pa.array(table[kind, place])], names=["good", "bin", "n"])

    threshold = 0.0
    if both:
        held = examples.where("held").select("url", "good").mapInArrow(histogram, "good boolean, bin int, n long").groupBy("good", "bin").agg(F.sum("n").alias("n")).collect()
        table = np.zeros((2, BINS))
        for r in held:
            table[int(r.good), r.bin] = r.n
        if table[0].any() and table[1].any():
            below = np.concatenate([np.zeros((2, 1)), np.cumsum(table, axis=1)], axis=1)
            wrong = below[1] / below[1, -1] + 1 - below[0] / below[0, -1]  # accepted ones below, rejected ones from there on
            best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
            threshold = float(best[np.abs(best - (BINS - 1) / 2).argmin()] / (BINS - 1) * 2 * SPAN - SPAN)

    def judge(iterator):
        for batch in iterator:
            rule, verdict = batch.column(4).field("rule"), batch.column(4).field("verdict")
            open_ = np.asarray(batch.column(4).is_null())
            score = np.zeros(batch.num_rows)
            if both:
                score[open_] = scores(batch.column(1).filter(pa.array(open_)).to_pylist())
            none = pa.array(open_)
            own = np.where(score >= threshold, "allow", "block").astype(object)
            verdict = pc.if_else(none, pa.array(own, pa.string()), verdict)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pc.if_else(none, None, rule), verdict, pa.array(score, mask=~open_)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    kind = judged.schema["page_id"].dataType.simpleString()
    return judged.select("page_id", "url", "host", "path", "by").mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


#: The rules that the query applies.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
