"""Byte-pair encoding by a depth-first walk over the prefix trie of distinct words.

An encoding of a prefix is given by its last token and, before that token, the encoding of a shorter prefix. The last
token of a prefix is the one vocabulary entry that ends it, encodes to itself, and may follow the last token of what is
left (two tokens may be neighbours if encoding their joint text gives back these two). So one token per trie node
describes all encodings; words with a common prefix share its nodes. Sorted words are the trie's depth-first order, and
the stack holds the states of the current path, so a trie needs no more memory than one word.

Defined results: a null text counts as empty; empty or blank texts give no tokens, the hash of the empty string and an
empty decoding. Each row gives one row, repeated rows too. Only doc_id and text are read; further columns are ignored.
Control strings of the vocabulary inside a text become their special ids, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from evidentia.llm.runtime import broadcast_value, map_arrow

#: White-space separated chunks whose encodings a worker keeps.
CACHE_WORDS = 150_000
#: Neighbour checks that a worker keeps.
CACHE_PAIRS = 200_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(keep))}
    return [rest.get(b, chr(b)) for b in range(256)]


class WordBPE:
    """Encoder and decoder for a word-end BPE file in the format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for content, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = content
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # the library's \s is the property White_Space; regex's also holds four control characters
        self.split = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.control = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.bytes = byte_alphabet()
        inner = [t for t in self.vocab if not (self.end and t.endswith(self.end))]
        last = [t[: -len(self.end)] for t in self.vocab if self.end and t.endswith(self.end)]
        self.longest = max(map(len, inner + last), default=1)
        self.translate = {b: c for b, c in enumerate(self.bytes)}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        self.endings = {t[k:] for t in self.vocab for k in range(len(t))}
        #: tokens that encode to themselves; no other token is ever a last token
        self.whole = {t: i for t, i in self.vocab.items() if self.merge(self.symbols(t)) == [t]}

    def merge(self, symbols: list[str]) -> list[str]:
        """Encoding by definition: of all pairs the one of the lowest rank merges first, from the left."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (self.rank.get((symbols[i], symbols[i + 1]), 1 << 60), i))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return [*token]

    def may_follow(self, left: int, right: int) -> bool:
        a, b = self.tokens[left], self.tokens[right]
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        known = self.fits[left << 32 | right] = self.merge(self.symbols(a) + self.symbols(b)) == [a, b]
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each distinct word as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        whole, fits, endings, longest, end = self.whole.get, self.fits.get, self.endings, self.longest, self.end
        paths = {w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.translate): w for w in words if w}
        states, starts, before = [-1], [0], ""
        for path in sorted(paths):
            size, shared = len(path), 0
            most = min(size - 1, len(before), len(states) - 1)
            while shared < most and path[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], starts[shared + 1 :]
            for depth in range(shared + 1, size + 1):
                state = -1
                tail = path[:depth] + end if depth == size else path[:depth]
                for start in range(depth - 1, depth - longest - 1 if depth > longest else -1, -1):
                    if (ending := tail[start:]) not in endings:
                        state = -1
                        break
                    if (token := whole(ending)) is not None:
                        if start:
                            if (left := states[start]) < 0:
                                continue
                            if (fit := fits(left << 32 | token)) is None:
                                fit = self.may_follow(left, token)
                            if not fit:
                                continue
                        state = token
                        break
                states.append(state)
                starts.append(start)
            ids, depth = [], size
            while depth and states[depth] >= 0:
                ids.append(states[depth])
                depth = starts[depth]
            if depth:  # a character that the vocabulary lacks
                ids = [self.vocab[t] for t in self.merge([*path[:-1], path[-1] + end]) if t in self.vocab][::-1]
            out[paths[path]] = pack(f"<{len(ids)}I", *ids[::-1])
            del states[size:], starts[size:]  # what ends a word is no state of a longer one
            before = path
        return out

    @staticmethod
    def lower(text: str) -> str:
        """Lower case by single characters, without the rule for a final sigma."""
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def chunked(self, text: str) -> list[str | int]:
        """The normalised text cut at white space, which no word crosses; special tokens as their ids."""
        parts = self.control.split(text) if self.control and any(s in text for s in self.special) else [text]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = self.lower(unicodedata.normalize("NFC", part))
                # str.split() also cuts at four control characters that are no White_Space
                out += [part] if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split()
        return out

    def pieces(self, chunk: str) -> list[str]:
        """The chunk's words by the vocabulary's pattern. Latin letters alone, or with a mark behind, need no pattern."""
        if max(chunk) < "\u0250":
            if chunk.isalpha():
                return [chunk]
            if chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.split.findall(chunk)

    def encode_batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        split = [self.chunked(t) for t in texts]
        new = set().union(*split) - self.chunks.keys()
        if len(self.chunks) + len(new) > CACHE_WORDS:
            self.chunks.clear()
            self.words.clear()
            new = set().union(*split)
        pieces = {c: self.pieces(c) for c in new if isinstance(c, str)}
        self.words |= self.encode_words(set().union(*pieces.values()) - self.words.keys())
        word = self.words.__getitem__
        self.chunks |= {c: b"".join(map(word, ps)) for c, ps in pieces.items()}
        self.chunks |= {c: np.array([c], "<u4").tobytes() for c in new if isinstance(c, int)}
        get = self.chunks.__getitem__
        for chunks in split:
            yield b"".join(map(get, chunks))

    def forget(self) -> None:
        """Drops what was kept of words, which a worker's later stages have no use for; the vocabulary stays."""
        self.chunks.clear()
        self.words.clear()

    def decode(self, ids: bytes) -> str:
        """The tokens joined by a space, as the library does for a file without a decoder; special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, *, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, and with `keep_ids` the ids and the decoded text.

    `path` names the vocabulary file, which the driver reads and broadcasts. One narrow pass; no shuffle."""
    model = broadcast_value(docs.sparkSession, lambda: WordBPE(path))  # a vocabulary, which doesn't grow with the data
    chunk = 2_000_000  # characters at a time, so that a batch of very long texts needs bounded memory

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model.value
        for batch in batches:
            ids, texts, start = batch.column(0), [t or "" for t in batch.column(1).to_pylist()], 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= chunk):
                    size += len(texts[stop])
                    stop += 1
                rows = [(len(b) // 4, hashlib.sha256(b).hexdigest(), d := bpe.decode(b), hashlib.sha256(d.encode()).hexdigest(), b if keep_ids else None) for b in bpe.encode_batch(texts[start:stop])]
                out = [ids.slice(start, stop - start), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[3] for r in rows])]
                if keep_ids:
                    out += [pa.array([np.frombuffer(r[4], "<u4").astype("i4") for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows])]
                yield pa.RecordBatch.from_arrays(out, names=names)
                start = stop
        bpe.forget()

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    names = [part.split()[0] for part in schema.split(", ")]
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"])
    return map_arrow(rows, run, schema)
