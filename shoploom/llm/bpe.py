"""BPE encoding and decoding by traversal of a trie that shares prefixes.

A sequence of tokens is the BPE encoding of its text if and only if each pair of
neighbours is the encoding of theirs. So the encoding of a prefix is fixed by its
last token and where that token begins, and each prefix follows from shorter
ones. The distinct words of a batch go into a trie; a depth-first walk carries
the last-token states of the current path, so a prefix that many words share is
worked out once. The ids of a word are then read backwards from its last token.

Texts are cut into pieces at white space, which no pre-token crosses; the
encodings of pieces are kept between batches, up to a fixed number of bytes.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.normalizers import NFC

from .storage import with_fields

#: Fixed value: the tokenizer file's pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Bytes of pieces whose results a worker keeps, twice at most, with what each takes beside its letters and ids; pairs of tokens that it keeps.
KEPT_BYTES, PIECE_BYTES, KEPT_PAIRS = 64 << 20, 200, 400_000
#: Rows of one output batch, and tokens that are joined in one Arrow array.
BATCH_ROWS, MOST_AT_ONCE = 512, 20_000_000

_NFC = NFC()  # by the library's edition of Unicode, which is not Python's
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def _byte_letters() -> str:
    """The letter that stands for each byte: itself if printable, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(spare)) for b in range(256))


def _tokens(spec: dict) -> list[str]:
    """The token of each id of a tokenizer file."""
    named = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    tokens = [""] * (max(named.values()) + 1)
    for t, i in named.items():
        tokens[i] = t
    return tokens


class Encoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.longest = max(len(t.removesuffix(WORD_END)) for t in self.vocab)
        self.added_re = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pre_token = regex.compile(PRE_TOKEN)
        self.letters = dict(enumerate(_byte_letters()))
        self._check(spec)
        self.ends = {t.removesuffix(WORD_END): t for t in self.vocab if t.endswith(WORD_END)}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_bytes = 0
        self.pairs: dict[str, dict[str, bool]] = {}
        self.known_pairs = 0

    def _check(self, spec: dict) -> None:
        """This walk is for one family of files: NFC, lower case, one pre-token pattern, word ends, and a token for every byte."""
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        patterns = [s["pattern"].get("Regex") for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if s.get("type") == "Split"]
        model = spec["model"]
        for wrong, what in (
            (steps != ["NFC", "Replace", "Lowercase"], f"normalizers {steps}"),
            (patterns != [PRE_TOKEN], f"pre-token patterns {patterns}"),
            (model.get("end_of_word_suffix") != WORD_END, f"word ends {model.get('end_of_word_suffix')!r}"),
            (any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or spec.get("decoder"), "options of the model or a decoder"),
        ):
            if wrong:
                raise ValueError(f"not a tokenizer file of this kind: {what}")
        missing = [x for letter in self.letters.values() for x in (letter, letter + WORD_END) if x not in self.vocab]
        if missing:
            raise ValueError(f"the vocabulary has no token for {missing[:5]}")

    def _symbols(self, token: str) -> list[str]:
        body = token.removesuffix(WORD_END)
        return [*body[:-1], body[-1] + token[len(body) :]]

    def _merge(self, parts: list[str]) -> list[str]:
        """Plain BPE, for a pair of tokens: the best-ranked neighbours merge until none has a rank."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fits(self, left: str, token: str) -> bool:
        """Whether left (empty: nothing) and token are the encoding of their joint text."""
        whole = (self._symbols(left) if left else []) + self._symbols(token)
        fits = self._merge(whole) == ([left, token] if left else [token])
        if self.known_pairs >= KEPT_PAIRS:
            self.pairs.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        self.pairs.setdefault(left, {})[token] = fits
        return fits

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word (in byte letters, not empty), by one walk over their trie.

        Sorted words are the trie in depth-first order: the states of the prefix
        that a word shares with the one before it still stand.
        """
        vocab, ends, longest, pairs, fits = self.vocab, self.ends, self.longest, self.pairs, self._fits
        deepest = max(map(len, words), default=0) + 1
        last, begin, found, before = [""] * deepest, [0] * deepest, {}, ""
        for word in sorted(words):
            n, known = len(word), 0
            most = min(n, len(before)) - 1  # the last letter of a word has a state of its own
            while known < most and word[known] == before[known]:
                known += 1
            for end in range(known + 1, n):
                start = end - longest if end > longest else 0
                while True:
                    token = word[start:end]
                    if token in vocab:
                        left = last[start]
                        ok = pairs[left].get(token) if left in pairs else None
                        if ok or (ok is None and fits(left, token)):
                            break
                    start += 1
                last[end], begin[end] = token, start
            start = n - longest if n > longest else 0
            while True:
                token = word[start:]
                if token in ends:
                    left, token = last[start], ends[token]
                    ok = pairs[left].get(token) if left in pairs else None
                    if ok or (ok is None and fits(left, token)):
                        break
                start += 1
            ids = [vocab[token]]
            while start:
                ids.append(vocab[last[start]])
                start = begin[start]
            ids.reverse()
            found[word], before = array("i", ids).tobytes(), word
        return found

    def _split(self, piece: str) -> list[str]:
        if piece.isalpha():
            found = [piece]
        elif piece[:-1].isalpha() and piece[-1] in ",.":
            found = [piece[:-1], piece[-1]]
        else:
            found = self.pre_token.findall(piece)
        if piece.isascii() and piece.isprintable():
            return found
        return [w.encode().decode("latin-1").translate(self.letters) for w in found]

    def _learn(self, pieces: set[str]) -> None:
        """Adds the ids of pieces, from the older ones if they are there."""
        kept = pieces & self.older.keys()
        split = {piece: self._split(piece) for piece in pieces - kept}
        words = self.encode_words({w for ws in split.values() for w in ws})
        for piece in kept:
            self.pieces[piece] = self.older[piece]
        for piece, ws in split.items():
            self.pieces[piece] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        self.kept_bytes += sum(PIECE_BYTES + 4 * len(piece) + len(self.pieces[piece]) for piece in pieces)

    def _cut(self, text: str) -> list[str]:
        if not text.isascii():
            text = _NFC.normalize_str(text).replace("Σ", "σ")  # lower-cased one letter at a time, whatever stands beside it
        text = text.lower()
        return [x for x in _SPACE.split(text) if x] if _ODD_SPACE.search(text) else text.split()

    def encode_batch(self, texts: list[str | None], specials: bool) -> list[bytes]:
        """The ids of each text as 32-bit numbers; specials: the strings of added tokens stand for these tokens."""
        cut: list[list] = []
        for text in texts:
            text = text or ""
            if specials and self.added_re is not None and any(t in text for t in self.added):
                cut.append([x if x in self.added else self._cut(x) for x in self.added_re.split(text)])
            else:
                cut.append([self._cut(text)])
        wanted = {x for parts in cut for p in parts if isinstance(p, list) for x in p}
        if self.kept_bytes > KEPT_BYTES:
            self.older, self.pieces, self.kept_bytes = self.pieces, {}, 0
        self._learn(wanted - self.pieces.keys())
        ids_of = self.pieces.__getitem__
        return [b"".join([array("i", [self.added[p]]).tobytes() if isinstance(p, str) else b"".join(map(ids_of, p)) for p in parts]) for parts in cut]


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def _encoded(part: pa.RecordBatch, path: str, text: str, specials: bool) -> pa.ListArray:
    found = encoder(path).encode_batch(part.column(text).to_pylist(), specials)
    ends = np.cumsum([0, *(len(f) // 4 for f in found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))


@cache
def _token_texts(path: str) -> pa.StringArray:
    """The token of each id: all that decoding needs of a file."""
    with open(path, encoding="utf-8") as f:
        return pa.array(_tokens(json.load(f)), pa.string())


def _decoded(column: pa.ListArray, tokens: pa.StringArray) -> pa.StringArray:
    column = pc.fill_null(column, [])
    flat = pc.list_flatten(column)
    known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), False)
    if len(flat) < MOST_AT_ONCE and pc.all(known, min_count=0).as_py():
        ends = pc.cumulative_sum(pc.list_value_length(column))
        lists = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), tokens.take(flat))
        return pc.binary_join(lists, " ")
    return pa.array([" ".join(tokens[i].as_py() for i in row if i is not None and 0 <= i < len(tokens)) for row in column.to_pylist()], pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", specials: bool = True) -> DataFrame:
    """Adds the token ids of a text column as array<int>.

    path is the tokenizer file, at the same place on every node, of the kind that
    Encoder._check lets pass; others raise. A null or empty text has no ids. Texts are encoded whole; repeated rows stay; a column named
    ids is replaced. An empty table gives an empty result.
    """
    schema = with_fields(docs, {ids: "array<int>"})
    names = schema.names[:-1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), _encoded(part, path, text, specials)], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids: the tokens joined by one space, as the file names no decoder.

    Null ids, and ids that are null or out of the vocabulary, add nothing.
    """
    schema = with_fields(docs, {decoded: "string"})
    names = schema.names[:-1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), _decoded(part.column(ids), _token_texts(path))], names=schema.names)

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", specials: bool = True) -> DataFrame:
    """encode and decode in the place of the text column: one Python worker for each task instead of two, and ids that don't go back and forth."""
    kept = [c for c in docs.columns if c not in (text, ids, decoded)]
    schema = with_fields(docs.select(kept), {ids: "array<int>", decoded: "string"})

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                found = _encoded(part, path, text, specials)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), found, _decoded(found, _token_texts(path))], names=schema.names)

    return docs.mapInArrow(run, schema)


def ids_text(ids: str = "ids"):
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
