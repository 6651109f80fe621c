"""Exact, cached use of a word-end BPE tokenizer of the tokenizers library inside a task."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Whole texts to token ids, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Text is cut at ASCII white space, which the tokenizer drops and never joins across. A batch's distinct
    words are looked up in a cache of bounded size and its ids are put together as one array. Plain texts
    (Latin letters, digits, punctuation) are lower-cased as columns and their new words go to the library's
    own model and byte alphabet; words of any other text (other scripts, combining marks, control
    characters, special-token strings) go through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        # Fixed pattern: how this tokenizer cuts a normalised word.
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # Up to U+024F letters lower-case one to one (but for U+0130) and nothing combines.
        self.odd = r"[^\t-\r -~\x{A1}-\x{AC}\x{AE}-\x{12F}\x{132}-\x{24F}]|<\|"
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.limit = limit

    def _learn_plain(self, words: list) -> None:
        cuts, new = [], set()
        for word in words:
            text = word.decode()
            parts = (text,) if text.isalpha() else self.cut(text)
            cuts.append(parts)
            new.update(parts)
        pieces = self.pieces
        if len(pieces) > self.limit:
            pieces.clear()
        new = [p for p in new if p not in pieces]
        for k in range(0, len(new), 512):
            part = new[k : k + 512]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            assert len(stops) == len(part), "every piece ends with a word-end token"
            raw = ids.tobytes()
            pieces.update(zip(part, [raw[a:b] for a, b in zip([0, *stops], stops)]))
        for word, parts in zip(words, cuts):
            self.words[word] = pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])

    def _learn_odd(self, words: list) -> None:
        texts = [w[1:].decode("utf-8", "replace") for w in words]
        for word, e in zip(words, self.whole.encode_batch_fast(texts, add_special_tokens=False)):
            self.words[word] = np.array(e.ids, dtype="<u4").tobytes()

    def _some(self, texts: pa.Array, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts if odd else pc.utf8_lower(texts))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        if odd:
            distinct = [b"\xff" + w for w in distinct]  # the same word may differ in a plain text
        known = self.words
        unknown = [w for w in distinct if w not in known]
        if len(known) + len(unknown) > self.limit:
            known.clear()
            unknown = distinct
        (self._learn_odd if odd else self._learn_plain)(unknown)
        ids = [known[w] for w in distinct]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        starts = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[index]
        stops = np.cumsum(n)
        total = int(stops[-1]) if len(stops) else 0
        out = pool[np.repeat(starts[index] - (stops - n), n) + np.arange(total)] if total else np.zeros(0, "<u4")
        edges = np.concatenate([[0], stops])[np.asarray(split.offsets) - split.offsets[0].as_py()]
        return out, edges

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, n + 1 offsets) of a string array; null counts as empty; ``end_id`` follows each text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        odd = np.asarray(pc.match_substring_regex(texts, self.odd)).astype(bool)
        parts, lengths = [], np.zeros(n, np.int64)
        for which in (False, True):
            rows = np.flatnonzero(odd == which)
            if len(rows):
                ids, edges = self._some(texts.take(pa.array(rows)) if len(rows) < n else texts, which)
                lengths[rows] = np.diff(edges)
                parts.append((rows, ids, edges))
        extra = int(end_id is not None)
        offsets = np.concatenate([[0], np.cumsum(lengths + extra)])
        if len(parts) == 1 and not extra:
            return parts[0][1], offsets
        out = np.full(int(offsets[-1]), end_id or 0, "<u4")
        for rows, ids, edges in parts:
            m = np.diff(edges)
            out[np.repeat(offsets[rows] - edges[:-1], m) + np.arange(len(ids))] = ids
        return out, offsets


_ENCODERS: dict = {}


def release() -> None:
    """Forget all encoders of this worker and their caches."""
    _ENCODERS.clear()


def encoder(path: str) -> WordEncoder:
    """One encoder, with its cache, for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
