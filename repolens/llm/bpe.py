"""Byte-pair encoding and decoding (operator 8).

One Aho-Corasick pass over a piece of text finds the longest token starting
at each byte.  A backtracking scan takes these tokens from left to right; it
steps back to a token's longest shorter prefix when two neighbours could not
stand side by side in the merged result, and marks dead positions so that
none is tried twice.  The result equals running all merges by rank, in time
linear in the text.  The pass runs once over the new pieces of many texts, joined
by a character that no token holds.  Decoding gathers bytes through an offset
table, in the same Python call as the encoding.

Defined results: a null text encodes as an empty one (no ids, empty decoded
text).  Strings of added tokens become their ids.  Texts of any length are
encoded whole; a long one is read in sections cut where the split pattern
always cuts.  Repeated rows give repeated results, an empty table an empty
one.  Other columns pass through; ``ids`` and ``decoded`` replace columns of
the same name.
"""

from __future__ import annotations

import json
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import hold

#: Fixed values of the byte-level vocabulary format: the split pattern.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest piece, most pieces and most pairs of a generation of a worker's
#: caches (caches only: two generations of either are kept, some 70 MB).
CACHE_BYTES, CACHE_PIECES, CACHE_PAIRS = 64, 1 << 17, 1 << 17
#: Slots of the pair table (a power of 2; a pair replaces another one).
PAIR_SLOTS = 1 << 20
#: Pieces looked up together, bytes of new pieces that one pass of the
#: automaton takes, matches read at once.
RUN_PIECES, PASS_BYTES, MATCHES = 1 << 17, 1 << 17, 1 << 16
#: Sections of long texts in code points, tokens decoded at once.
SECTION, DECODE_TOKENS = 1 << 18, 1 << 20


def _byte_letters() -> dict[str, int]:
    """The vocabulary file writes printable bytes as themselves and the rest,
    in order, as the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class _Recent:
    """A bounded cache in two generations: when the young one is full it
    becomes the old one, and what is asked for again comes back from there."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Vocabulary:
    """Tables of one vocabulary file: token bytes, offsets, splits, merges,
    shorter prefixes and the automaton."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        d = json.loads(spec)
        model, letters = d["model"], _byte_letters()
        if model["type"] != "BPE" or d["pre_tokenizer"]["type"] != "ByteLevel" or d["normalizer"] or d["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(t.get(flag) for t in d["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip or match whole words are not supported")
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        to_bytes = lambda s: bytes(letters[c] for c in s)
        n = max([*model["vocab"].values(), *self.added.values()]) + 1
        tokens: list[bytes] = [b""] * n
        for s, i in model["vocab"].items():
            tokens[i] = to_bytes(s)
        self.by_bytes = {t: i for i, t in enumerate(tokens) if t}
        for s, i in self.added.items():
            tokens[i] = s.encode()
        self.size = [len(t) for t in tokens]
        self.sizes, self.most = np.array(self.size, np.int64), max(map(len, self.by_bytes))
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        # Rank of a token: when its merge happens; single bytes never do.
        self.rank, self.halves, self.merged = [-1] * n, [(i, i) for i in range(n)], {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = model["vocab"][a], model["vocab"][b]
            whole = self.by_bytes[tokens[a] + tokens[b]]
            self.merged[a, b] = whole
            if self.rank[whole] < 0:
                self.rank[whole], self.halves[whole] = r, (a, b)
        self.shorter = [-1] * n
        machine = ahocorasick.Automaton()
        for t, i in self.by_bytes.items():
            machine.add_word(t.decode("latin-1"), i)
            self.shorter[i] = next((self.by_bytes[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.by_bytes), -1)
        machine.make_automaton()
        self.machine = machine
        # The pair table: by hash for whole arrays, by key for single pairs.
        self.held, self.held_ok = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.pairs = _Recent(CACHE_PAIRS)
        self.split = regex.compile(SPLIT).findall
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache = _Recent(CACHE_PIECES)

    def _fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side: going back through
        the merges that made them, latest first, no merge across their border
        would have come before those that were made."""
        until = len(self.rank)  # merges of this rank and later have been undone
        while True:
            across = self.merged.get((a, b))
            if across is not None and self.rank[across] < until:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            # Equal merges are made from left to right: one across the border
            # comes after those within a, but before those within b.
            if ra > rb:
                until, a = ra, self.halves[a][1]
            else:
                until, b = rb + 1, self.halves[b][0]

    def _stands(self, pair: int) -> bool:
        """Whether a pair a * n + b can stand side by side, from the table."""
        ok = self.pairs.young.get(pair)
        if ok is None:
            ok = self.pairs.old.get(pair)
            if ok is None:
                ok = self._fits(*divmod(pair, len(self.size)))
            self.pairs.put(pair, ok)
        return ok

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as bytes of 32-bit numbers."""
        joined, n = "\u0100".join([p.encode().decode("latin-1") for p in pieces]), len(self.size)
        if not joined:
            return []
        # One pass of the automaton: the scan that only takes longest tokens.
        found, parts = chain.from_iterable(self.machine.iter_long(joined)), []
        while len(part := np.fromiter(islice(found, 2 * MATCHES), np.int64)):
            parts.append(part)
        flat = np.concatenate(parts)
        taken, ends = flat[1::2], flat[::2] + 1
        starts = ends - self.sizes[taken]
        # Its neighbours that can't stand side by side.
        beside = ends[:-1] == starts[1:]
        pairs = (taken[:-1] * n + taken[1:])[beside]
        slot = pairs * 0x9E3779B97F4A7C1 >> 40 & len(self.held) - 1
        ok, unknown = self.held_ok[slot], np.flatnonzero(self.held[slot] != pairs)
        if len(unknown):
            other, back = np.unique(pairs[unknown], return_inverse=True)
            found = np.array([self._fits(p // n, p % n) for p in other.tolist()], bool)[back]
            ok[unknown], self.held_ok[slot[unknown]], self.held[slot[unknown]] = found, found, pairs[unknown]
        wrong = np.flatnonzero(beside)[~ok] + 1
        first = np.concatenate([[0], np.flatnonzero(~beside) + 1, [len(taken)]])
        owner, at = np.unique(np.searchsorted(first, wrong, "right") - 1, return_index=True)
        blob, first = taken.astype(np.int32).tobytes(), first.tolist()
        results = [blob[4 * x:4 * y] for x, y in zip(first, first[1:])]
        starts, taken, ends = starts.tolist(), taken.tolist(), ends.tolist()
        longest = dict(zip(starts, taken))
        for piece, k in zip(owner.tolist(), wrong[at].tolist()):
            x, y = first[piece], first[piece + 1]
            results[piece] = self._step_back(joined, ends[y - 1], taken[x:k], starts[k], longest)
        return results

    def _step_back(self, joined: str, stop: int, before: list[int], pos: int, longest: dict[int, int]) -> bytes:
        """The ids up to ``stop``, going on at ``pos`` behind the tokens
        ``before``; ``longest`` has the longest token at some places."""
        out, size, shorter, n, known, dead = before, self.size, self.shorter, len(self.size), self.pairs.young, set()
        token, last = longest[pos], out[-1] if out else -1
        while True:
            if last < 0:
                ok = True
            else:
                pair = last * n + token
                ok = known.get(pair)
                if ok is None:
                    ok = self._stands(pair)
                    known = self.pairs.young
            end = pos + size[token]
            if ok and end not in dead:
                out.append(token)
                pos, last = end, token
                if pos == stop:
                    return array("i", out).tobytes()
                token = longest.get(pos)
                if token is None:
                    token = longest[pos] = next(self.machine.iter_long(joined[pos:min(stop, pos + self.most)]))[1]
                continue
            token = shorter[token]
            if token < 0:
                dead.add(pos)
                token = out.pop()
                last = out[-1] if out else -1
                pos -= size[token]

    def _new(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that the young generation lacks."""
        known, todo, held = {}, [], 0
        for p in pieces:
            ids = self.cache.old.get(p)
            if ids is not None:
                known[p] = ids
                continue
            todo.append(p)
            held += len(p)
            if held >= PASS_BYTES:
                known.update(zip(todo, self.encode_pieces(todo), strict=True))
                todo, held = [], 0
        known.update(zip(todo, self.encode_pieces(todo), strict=True))
        for p, ids in known.items():
            if len(p) <= CACHE_BYTES:
                self.cache.put(p, ids)
        return known

    def _sections(self, text: str):
        at = 0
        while len(text) - at > SECTION:
            m = self.cut.search(text, at + SECTION)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, held = [], 0  # runs of pieces with their new ones

        def settle():
            known = self._new({p for *_, new in waiting for p in new.values()})
            for i, k, ids, new in waiting:
                for at, p in new.items():
                    ids[at] = known[p]
                out[i][k] = b"".join(ids)
            waiting.clear()

        for i, text in enumerate(texts):
            for part in self.special.split(text) if self.special and any(s in text for s in self.added) else (text,):
                if part in self.added:
                    out[i].append(array("i", [self.added[part]]).tobytes())
                    continue
                for section in self._sections(part):
                    pieces = self.split(section)
                    ids = list(map(self.cache.young.get, pieces))
                    if None not in ids:
                        out[i].append(b"".join(ids))
                        continue
                    waiting.append((i, len(out[i]), ids, {k: pieces[k] for k, x in enumerate(ids) if x is None}))
                    out[i].append(b"")
                    held += len(ids)
                    if held >= RUN_PIECES:
                        settle()
                        held = 0
        settle()
        return [np.frombuffer(b"".join(x), np.int32) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """Text of a run of ids."""
        data = b"".join(self.decode_bytes(ids[k:k + DECODE_TOKENS].astype(np.int64)).tobytes() for k in range(0, len(ids), DECODE_TOKENS))
        return data.decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids."""
        start, size = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(size)
        return self.blob[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(name: str, spec: str) -> Vocabulary:
    hold("bpe", _loaded.clear)
    if name not in _loaded:
        _loaded[name] = Vocabulary(spec)
    return _loaded[name]


class Tokenizer:
    """A vocabulary file as Spark columns.  The file (about 1.5 MB) is read
    once on the driver and travels as a broadcast variable, so executors need
    no path to it."""

    def __init__(self, spark, path: str):
        import hashlib

        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self._spec, self._name = spark.sparkContext.broadcast(spec), hashlib.sha256(spec.encode()).hexdigest()

    def encode(self, text: Column) -> Column:
        """struct<ids: array<int>, decoded: string>: the ids and the text read
        back from them, in one call (two calls would encode twice)."""
        spec, name = self._spec, self._name

        @F.arrow_udf("struct<ids: array<int>, decoded: string>")
        def encode(a: pa.Array) -> pa.Array:
            v = _vocabulary(name, spec.value)
            ids = v.encode_all([s or "" for s in a.to_pylist()])
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32()))
            return pa.StructArray.from_arrays([lists, pa.array([v.decode(x) for x in ids], pa.string())], ["ids", "decoded"])

        return encode(text)

    def decode(self, ids: Column) -> Column:
        """string of an array<int>."""
        spec, name = self._spec, self._name

        @F.arrow_udf("string")
        def decode(a: pa.Array) -> pa.Array:
            v = _vocabulary(name, spec.value)
            return pa.array([v.decode(np.asarray(x.values, np.int32) if x.is_valid else np.empty(0, np.int32)) for x in a], pa.string())

        return decode(ids)


def encode_table(df: DataFrame, tokenizer: Tokenizer, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``decoded``."""
    both = [c for c in df.columns if c not in ("ids", "decoded")]
    rows = df.select(F.struct("*").alias("row"), tokenizer.encode(F.col(text_col)).alias("both"))
    return rows.select(*[F.col("row")[c].alias(c) for c in both], F.col("both.ids").alias("ids"), F.col("both.decoded").alias("decoded"))


def token_digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``encode_table``: number of ids and digests of ids and
    decoded text."""
    return encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
