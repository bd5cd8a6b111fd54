"""Operator 7: byte-level BPE as a streaming transducer, and back.

Tokens are read left to right: the longest token that may stand beside its left neighbour, with a
step back where the rest cannot be continued. Two tokens may stand side by side when merging their
bytes gives just those two; a sequence whose neighbours all may is the merge list's own result.
From the merge list follows how many bytes after a token can still change it. Tokens further back
than that are stable and are emitted, so a piece of any length needs constant memory. Decoding
feeds token bytes to an incremental UTF-8 state machine.

The vocabulary file is a parameter; its text (1.5 MB for 50,000 tokens) is all that is broadcast.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Fixed: the pattern that parts a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose tokens a worker remembers (two generations of this many), and pairs.
REMEMBERED, PAIRS = 150_000, 400_000
#: Characters of a text from which its pieces are found one after the other, and packed ids that are digested
#: at a time: beyond these a text costs no more memory than itself.
LONG, BLOCK = 1 << 20, 1 << 16


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this kind: printable Latin-1
    characters stand for themselves, the others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ShortLookahead(ValueError):
    """A token that was emitted as stable would have to change."""


class Transducer:
    """Tables of one vocabulary, and the two machines that use them."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        letters = byte_alphabet()
        raw = lambda t: bytes(letters[c] for c in t)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        words = {t: i for t, i in model["model"]["vocab"].items() if t not in self.special}
        self.text = {i: raw(t) for t, i in words.items()} | {i: t.encode() for t, i in self.special.items()}
        self.single = {self.text[i]: i for t, i in words.items() if len(self.text[i]) == 1}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.rules = {(words[a], words[b]): (rank, words[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.made = {new: pair for pair, (_, new) in self.rules.items()}
        # Where each token is made by one merge, of tokens made before, two neighbours are tried backwards along it (stays).
        self.rank = {i: -1 for i in words.values()} | {new: rank for new, (rank, _) in ((n, self.rules[p]) for n, p in self.made.items())}
        self.plain = len(self.made) == len(self.rules) == len(pairs) and all(max(self.rank[a], self.rank[b]) < self.rank[new] for new, (a, b) in self.made.items())
        self.lookahead = self._sufficient_lookahead()
        # A token that its own bytes don't merge to is never emitted.
        self.token = {self.text[i]: i for i in words.values() if self.merged(self.text[i]) == [i]}
        self.tree, self.longest = self._tree(), max(map(len, self.token))
        self.mark = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.packed = [b""] * (max(self.text) + 1)
        for i in self.text:
            self.packed[i] = int(i).to_bytes(4, "little")
        self.bytes_of = [self.text.get(i, b"") for i in range(len(self.packed))]
        self.beside: dict[int, bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _sufficient_lookahead(self) -> int:
        """Bytes to the right of a token that can decide whether it stays. A merge (u, v) needs the
        bytes of v, and those that an earlier merge with a token on v's right edge may need."""
        need, most = {}, 1
        for (u, v), _ in self.rules.items():  # in order of rank
            edge, further = v, need.get(v, 0)
            while edge in self.made:
                edge = self.made[edge][1]
                further = max(further, need.get(edge, 0))
            now = len(self.text[v]) + further
            need[u] = max(need.get(u, 0), now)
            most = max(most, now)
        return most + max(map(len, self.text.values()))

    def merged(self, raw: bytes) -> list[int]:
        """The merge list applied to a few bytes."""
        ids = [self.single[raw[i : i + 1]] for i in range(len(raw))]
        while len(ids) > 1:
            found = min(((*self.rules[p], p) for p in zip(ids, ids[1:], strict=False) if p in self.rules), default=None)
            if found is None:
                break
            _, made, pair = found
            at, out = 0, []
            while at < len(ids):
                if at + 1 < len(ids) and (ids[at], ids[at + 1]) == pair:
                    out.append(made)
                    at += 2
                else:
                    out.append(ids[at])
                    at += 1
            ids = out
        return ids

    def _tree(self) -> dict[int, tuple]:
        """Prefix tree of the tokens: for each byte the branches behind it and its token, or -1."""
        root: dict[int, tuple] = {}
        for raw, i in self.token.items():
            kids = root
            for b in raw[:-1]:
                kids = kids.setdefault(b, ({}, -1))[0]
            kids[raw[-1]] = (kids[raw[-1]][0] if raw[-1] in kids else {}, i)
        return root

    def may_meet(self, a: int, b: int) -> bool:
        if len(self.beside) >= PAIRS:
            self.beside.clear()
        known = self.beside[a << 32 | b] = self.stays(a, b) if self.plain else self.merged(self.text[a] + self.text[b]) == [a, b]
        return known

    def stays(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens gives just these. Their merges are undone from the last to the first; what then
        meets must not have merged before the merge that was undone (of the same merge the left one comes first)."""
        limit, rules, rank = len(self.rules), self.rules.get, self.rank
        while True:
            found = rules((a, b))
            if found is not None and found[0] < limit:
                return False
            left, right = rank[a], rank[b]
            if left > right:
                limit, a = left, self.made[a][1]
            elif right < 0:
                return True
            else:
                limit, b = right + 1, self.made[b][0]

    def stream(self, raw: bytes) -> Iterator[int]:
        """Token ids of one piece, emitted once stable."""
        tree, longest, beside, n = self.tree, self.longest, self.beside.get, len(raw)
        held: list[tuple[int, int]] = []  # (id, end) of tokens that may still change
        dead: set[int] = set()  # places from which the rest can't be continued
        at, left, limit = 0, -1, n
        while at < n:
            kids, to, fits = tree, at, []
            for b in raw[at : at + longest if at + longest < limit else limit]:
                node = kids.get(b)
                if node is None:
                    break
                to += 1
                kids, i = node
                if i >= 0:
                    fits.append((i, to))
            while fits:
                i, to = fits.pop()
                if to in dead:
                    continue
                if left < 0:
                    break
                known = beside(left << 32 | i)
                if self.may_meet(left, i) if known is None else known:
                    break
            else:  # step back and try the last token shorter
                dead.add(at)
                if not held:
                    raise ShortLookahead(left)
                held.pop()
                limit = at - 1
                left, at = held[-1] if held else (before, base)
                continue
            if not held:
                base, before = at, left
            held.append((i, to))
            left, at, limit = i, to, n
            if len(held) > 64 and held[32][1] < at - self.lookahead:
                k = next(k for k, (_, end) in enumerate(held) if end >= at - self.lookahead)
                before, base = held[k - 1]
                for i, _ in held[:k]:
                    yield i
                del held[:k]
                dead = {d for d in dead if d > base}
        for i, _ in held:
            yield i

    def piece(self, piece: str) -> bytes:
        """The packed ids of a piece; words recur, so they are remembered."""
        found = self.old.get(piece)
        if found is None:
            raw = piece.encode()
            try:
                found = b"".join([self.packed[i] for i in self.stream(raw)])
            except ShortLookahead:  # of a merge list for which the bound doesn't hold
                found = b"".join([self.packed[i] for i in self.merged(raw)])
        if len(piece) <= 64:
            if len(self.new) >= REMEMBERED:
                self.new, self.old = {}, self.new
            self.new[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(self.flow(text))

    def flow(self, text: str) -> Iterator[bytes]:
        """The same piece after piece."""
        at = 0
        for m in self.mark.finditer(text) if self.mark and any(s in text for s in self.special) else ():
            yield from self._plain(text, at, m.start())
            yield self.packed[self.special[m[0]]]
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, begin: int, end: int) -> Iterator[bytes]:
        part = text if end - begin == len(text) else text[begin:end]
        if len(part) < BLOCK:  # its pieces and ids are no more than a block
            found = self.pieces.findall(part)
            known = list(map(self.new.get, found))
            if None in known:
                known = [x or self.new.get(p) or self.piece(p) for p, x in zip(found, known, strict=True)]
            yield b"".join(known)
            return
        for p in self.pieces.findall(part) if len(part) < LONG else (m[0] for m in self.pieces.finditer(part)):
            x = self.new.get(p)
            if x is not None:
                yield x
            elif len(p) < BLOCK // 4:
                yield self.piece(p)
            else:
                yield from self.passed_on(p)

    def passed_on(self, piece: str) -> Iterator[bytes]:
        """The packed ids of a long piece in blocks, each as soon as its ids are stable."""
        held, gone = [], False
        raw = piece.encode()
        try:
            for i in self.stream(raw):
                held.append(self.packed[i])
                if len(held) >= BLOCK // 4:
                    yield b"".join(held)
                    held, gone = [], True
        except ShortLookahead:  # of a merge list for which the bound doesn't hold
            if gone:
                raise
            held = [self.packed[i] for i in self.merged(raw)]
        yield b"".join(held)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids and of the decoded text in UTF-8, whose bytes are passed on as
        they come: encoder, decoder and digests hold a block of ids at most."""
        ids, decoded, machine, n = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace"), 0
        held, size = [], 0

        def passed(last: bool) -> None:
            block = b"".join(held)
            held.clear()
            ids.update(block)
            raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(block, dtype="<u4").tolist()))
            decoded.update(machine.decode(raw, final=last).encode())

        for x in self.flow(text):
            held.append(x)
            size += len(x)
            n += len(x)
            if size >= BLOCK:
                passed(False)
                size = 0
        passed(True)
        return n // 4, ids.hexdigest(), decoded.hexdigest()

    def decode(self, ids: Iterable[int], block: int = 1 << 16) -> str:
        machine, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        ids = ids if isinstance(ids, list) else list(ids)
        for at in range(0, len(ids), block):
            out.append(machine.decode(b"".join([self.bytes_of[i] for i in ids[at : at + block]])))
        return "".join([*out, machine.decode(b"", final=True)])


_BUILT: dict[str, Transducer] = {}


def built(spec: str) -> Transducer:
    """The tables of a vocabulary, made once in each worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Transducer(spec)
    return _BUILT[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """All rows with their token ids in an array column."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        t = built(spec.value)
        return pa.array([np.frombuffer(t.encode(x.as_py() or ""), dtype="<i4") for x in texts], pa.list_(pa.int32()))

    return docs.withColumn(ids, run(F.col(text)))


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """All rows with the text of their token ids (null: empty; unknown ids give nothing)."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = rows.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        t = built(spec.value)
        return pa.array([t.decode([i for i in x.as_py() or [] if i is not None and 0 <= i < len(t.bytes_of)]) for x in lists], pa.string())

    return rows.withColumn(text, run(F.col(ids)))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """For each row its id, number of tokens and the digests of ids and decoded text, made as these stream by."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pa.Array) -> pa.Array:
        t = built(spec.value)
        found = [t.digest(x.as_py() or "") for x in texts]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("_r")).select("doc_id", "_r.*")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
