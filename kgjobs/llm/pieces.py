"""SentencePiece encoding and decoding: merge-ordered pieces found by a max-plus scan over chunks.

The vocabulary file is a merge-ordered (BPE) SentencePiece model, so the segmentation wanted is the one its merges
give. A sequence of pieces is that segmentation exactly if each piece re-encodes to itself and every two neighbours
re-encode to themselves. So the lattice's states are pieces, an arc between compatible neighbours weighs 0 and every
other one minus infinity: the one path of weight 0 is the result, whatever the scores' scale.

Texts of at most ``chunk`` characters are one chunk. Longer ones are cut every ``chunk`` characters, anywhere. The
state at a cut is the piece that covers the character before it. Each chunk yields, apart from all others, the max-plus
matrix from its entry states to its exit states (only entries of weight 0 are kept). Matrices of ``fan`` neighbours are
multiplied to one, these again, until a text has ``fan`` at most; then states go down the same tree, from a node's entry
and exit to those of its parts. So each chunk comes to know its entry and exit state and is traced back on its own. A
text lies whole in a task where it is cut and where its ids are returned, nowhere between.

Within a chunk, no piece spans a place where a space follows a non-space (checked when the vocabulary is loaded), so
words are segmented once each and looked up after that.

Defined cases: null text is empty; an empty text has no ids; characters without a piece become byte pieces; U+2581,
which stands for a space in the vocabulary, decodes as a space (``round_trip`` is false then); repeated rows and ids
stay apart; other columns are kept, but for those named ids, n_tokens or round_trip.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import brought_back, set_aside, shuffles, small_batches, written

CHUNK = 16384
#: Matrices that are multiplied in one step.
FAN = 32
#: Words whose pieces a worker remembers.
REMEMBER = 1_000_000
SPACE = "▁"
START = -1
NEVER = float("-inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary: segmentation of words, compatible neighbours, and ids."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [b"" if special[i] else sp.id_to_piece(i).encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            self.bytes_of[i] = bytes([b])
        self.table = pa.array(self.bytes_of, pa.binary())
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space after another character; words can't be cut apart")
        apart = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids if len(p) > 1))
        self.words = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|[{apart}]" if apart else ""))
        self.apart = set(apart)
        self.raw_of = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.known = Known(self)
        self.pair: dict[tuple[str, str], bool] = {}

    def merge(self, word: str) -> list[str]:
        """Pieces of a short string: the neighbours whose joint piece scores highest merge first, the leftmost of equals."""
        parts, score = list(word), self.score.get
        joint = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while joint:
            best = max(joint)
            if best == NEVER:
                break
            i = joint.index(best)  # the leftmost
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joint[i]
            if i:
                joint[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(joint):
                joint[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def whole(self, piece: str) -> bool:
        """Whether the piece is a possible state: one character, or a piece that its own merges give."""
        return len(piece) == 1 or self.fits(piece, "")

    def fits(self, left: str, right: str) -> bool:
        """Whether two neighbours re-encode to themselves."""
        if left not in self.ids or (right and right not in self.ids):
            return not (len(left) > 1 and left not in self.ids)
        got = self.pair.get((left, right))
        if got is None:
            if len(self.pair) >= REMEMBER:
                self.pair.clear()
            got = self.pair[left, right] = self.merge(left + right) == ([left, right] if right else [left])
        return got

    def bound(self, s: str, at: int) -> bool:
        """Whether no piece spans the place before s[at]."""
        return (s[at] == SPACE and s[at - 1] != SPACE) or s[at] in self.apart or s[at - 1] in self.apart

    def nexts(self, s: str, at: int) -> Iterator[int]:
        """Ends of the pieces that begin at s[at]."""
        yield at + 1
        for end in range(at + 2, min(len(s), at + self.longest) + 1):
            if s[at:end] in self.ids and self.whole(s[at:end]):
                yield end

    def covering(self, s: str, at: int) -> list[tuple[int, int]]:
        """(begin, end) of the pieces that cover s[at]."""
        return [(a, e) for a in range(max(0, at - self.longest + 1), at + 1) for e in self.nexts(s, a) if e > at]

    def sweep(self, s: str, entries: dict[tuple[int, int], int], last: int, trace: dict | None = None) -> dict[tuple[int, int], int]:
        """Exit states, the pieces that cover s[last], with the bits of the entry states they can be reached from.

        entries: (begin, end) of a piece and its bit; (0, 0) is the start of a text. trace gets, for each piece
        reached, the one before it (one entry only; then there is one way at most).
        """
        ends: dict[int, dict[int, int]] = {}
        exits: dict[tuple[int, int], int] = {}
        for (a, e), bit in entries.items():
            if a <= last < e:
                exits[a, e] = exits.get((a, e), 0) | bit
            else:
                ends.setdefault(e, {})[a] = bit
        low = s.rfind(SPACE, 0, last + 1)
        skip_to = next((k for k in range(last, max(low, 0), -1) if self.bound(s, k)), low if low > 0 and self.bound(s, low) else 0)
        while ends:
            at = min(ends)
            before = ends.pop(at)
            free = at == 0 or self.bound(s, at)
            if free:
                all_bits = 0
                for bits in before.values():
                    all_bits |= bits
                if at < skip_to:  # words between two bounds don't hang on the state
                    if trace is not None:
                        trace["gap"] = (at, skip_to, next(iter(before)))
                    ends.setdefault(skip_to, {})[skip_to] = ends.get(skip_to, {}).get(skip_to, 0) | all_bits
                    continue
            for end in self.nexts(s, at):
                piece, bits = s[at:end], 0
                for a, b in before.items():
                    if free or a == at or self.fits(s[a:at], piece):
                        bits |= b
                        if trace is not None:
                            trace[at, end] = (a, at)
                if bits:
                    if at <= last < end:
                        exits[at, end] = exits.get((at, end), 0) | bits
                    else:
                        ends.setdefault(end, {})[at] = bits
        return exits

    def path(self, s: str, entry: tuple[int, int], exit: tuple[int, int]) -> bytes:
        """Ids of the pieces after entry up to exit, both states known."""
        if entry == exit:
            return b""
        trace: dict = {}
        self.sweep(s, {entry: 1}, exit[1] - 1 if exit[0] >= entry[1] else exit[0], trace)
        gap, out, at = trace.pop("gap", None), [], exit
        while at != entry:
            out.append(self.raw(s[at[0] : at[1]]))
            if gap and at[0] == gap[1]:
                out.append(self.text_ids(s[gap[0] : gap[1]]))
                at = (gap[2], gap[0])
            else:
                at = trace[at]
        return b"".join(reversed(out))

    def raw(self, piece: str) -> bytes:
        return self.raw_of.get(piece) or b"".join([self.byte[b].to_bytes(4, "little") for b in piece.encode()])

    def word_ids(self, word: str) -> bytes:
        if len(word) <= 48:
            return b"".join(map(self.raw, self.merge(word)))
        (exit,) = [x for x in self.sweep(word, {(0, 0): 1}, len(word) - 1) if x[1] == len(word)]
        return self.path(word, (0, 0), exit)

    def text_ids(self, s: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.words.findall(s)))

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([np.asarray(ids, "<i4").tobytes()])[0]

    def decode_all(self, raw: list[bytes]) -> list[str]:
        """Texts of lists of ids (as bytes): the pieces of all are gathered at once, then cut apart."""
        ends = np.cumsum([0, *(len(r) // 4 for r in raw)])
        taken = self.table.take(pa.array(np.frombuffer(b"".join(raw), "<i4")))
        at = np.frombuffer(taken.buffers()[1], np.int32)[ends] if ends[-1] else np.zeros(len(ends), np.int32)
        data = memoryview(taken.buffers()[2]) if ends[-1] else b""
        return [str(data[a:b], "utf-8", "replace").replace(SPACE, " ").removeprefix(" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class Known(dict):
    """word -> ids, remembered for short words."""

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        got = self.pieces.word_ids(word)
        if len(word) <= 48:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = got
        return got


@lru_cache(maxsize=2)
def load(model: str) -> Pieces:
    return Pieces(model)


def _listed(raw: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(b) // 4 for b in raw), np.int32, len(raw))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def _packed(raw: bytes) -> bytes:
    """Ids of 4 bytes each as their width and ids of 2 bytes where that is enough: less to shuffle."""
    ids = np.frombuffer(raw, "<i4")
    return b"\4" + raw if ids.max(initial=0) > 65535 else b"\2" + ids.astype("<u2").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<i4", offset=1).astype("<i4")


def _matrix(p: Pieces, s: str, begin: int, end: int) -> list[int]:
    """Pairs of entry and exit states of weight 0, flat; a state is coded by how far its piece reaches to either side of the cut.

    s: the chunk [begin, end) with what stands beside it; begin 0 is the start of the text.
    """
    code = lambda a, e, cut: (cut - 1 - a) * 64 + (e - cut)
    entries = [(0, 0)] if begin == 0 else p.covering(s, begin - 1)
    exits = p.sweep(s, {x: 1 << i for i, x in enumerate(entries)}, end - 1)
    return [v for (a, e), bits in exits.items() for i, x in enumerate(entries) if bits >> i & 1 for v in (START if begin == 0 else code(*x, begin), code(a, e, end))]


def combine(a: dict[int, frozenset], b: dict[int, frozenset]) -> dict[int, frozenset]:
    """Max-plus product of two matrices of zeros and minus infinities, as rows of the columns that are zero."""
    return {i: frozenset().union(*[b.get(j, frozenset()) for j in js]) for i, js in a.items()}


def product(matrices: list[dict[int, frozenset]]) -> dict[int, frozenset]:
    """The matrix of neighbouring chunks together."""
    out = matrices[0]
    for m in matrices[1:]:
        out = combine(out, m)
    return out


def states_between(matrices: list[dict[int, frozenset]], first: int, last: frozenset) -> list[int]:
    """The states at the cuts from ``first`` on: reached from it by the product before a cut and leading to ``last`` by the one after it."""
    back, after = last, []
    for m in reversed(matrices):
        after.append(back)
        back = frozenset(i for i, js in m.items() if js & back)
    out = [first]
    for m, ok in zip(matrices, reversed(after), strict=True):
        (state,) = m[out[-1]] & ok
        out.append(state)
    return out


def _rows(pairs: list[int]) -> dict[int, frozenset]:
    m: dict[int, set] = {}
    for i, j in zip(pairs[::2], pairs[1::2], strict=True):
        m.setdefault(i, set()).add(j)
    return {i: frozenset(js) for i, js in m.items()}


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [product([_rows(x["pairs"]) for x in parts]) for parts in b.column("parts").to_pylist()]
        flat = [[v for i, js in m.items() for j in js for v in (i, j)] for m in made]
        yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("k"), pa.array(flat, pa.list_(pa.int32()))], names=["_row", "k", "pairs"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, k, entry, exit) of the parts of nodes with known ends; a null exit is the end of the text, reached by a piece that ends with it."""
    kinds = [("_row", pa.int64()), ("k", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32())]
    for b in batches:
        rows = []
        for row, parts, entry, out in zip(*[b.column(c).to_pylist() for c in ("_row", "parts", "entry", "exit")], strict=True):
            made = [_rows(x["pairs"]) for x in parts]
            last = frozenset(j for js in made[-1].values() for j in js if j % 64 == 0) if out is None else frozenset([out])
            at = states_between(made, entry, last)
            rows += [{"_row": row, "k": x["k"], "entry": at[n], "exit": at[n + 1]} for n, x in enumerate(parts)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def tree_states(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """(_row, k, entry, exit) of every chunk of matrices(_row, k, pairs), by products up a tree of ``fan`` and states down it."""
    node = (F.col("k") / fan).cast("int")
    parts = F.array_sort(F.collect_list(F.struct("k", "pairs"))).alias("parts")
    levels = [written(matrices, "pieces-matrices")]
    while (levels[-1].agg(F.max("k").alias("k")).first()["k"] or 0) >= fan:
        up = levels[-1].groupBy("_row", node.alias("k")).agg(parts).mapInArrow(_multiplied, "_row long, k int, pairs array<int>")
        levels.append(written(up, "pieces-products"))
    states = levels[-1].groupBy("_row").agg(parts).withColumns({"entry": F.lit(START), "exit": F.lit(None).cast("int")})
    states = states.mapInArrow(_states, "_row long, k int, entry int, exit int")
    for level in reversed(levels[:-1]):
        below = level.groupBy("_row", node.alias("node")).agg(parts)
        below = below.join(states.withColumnRenamed("k", "node"), ["_row", "node"])
        states = written(below.mapInArrow(_states, "_row long, k int, entry int, exit int"), "pieces-states")
    return states


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK, text: str = "text", fan: int = FAN) -> DataFrame:
    """docs with ids array<int>, n_tokens and round_trip (whether decoding the ids gives the text back)."""
    spark, model, every = docs.sparkSession, model or default_model(), docs
    small_batches(spark)
    docs = set_aside(docs, text)
    size = F.length(F.coalesce(text, F.lit("")))
    schema = docs.select(text, "_aside").schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model)
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            raw = [p.text_ids((SPACE + t).replace(" ", SPACE)) if t else b"" for t in texts]
            same = [a == t for a, t in zip(p.decode_all(raw), texts, strict=True)]
            ids = _listed(raw)
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array(same)], names=[*b.schema.names, "ids", "n_tokens", "round_trip"])

    done = docs.where(size <= chunk).mapInArrow(short, schema)
    long = written(docs.where(size > chunk).withColumn("_row", F.monotonically_increasing_id()), "pieces-long")
    return brought_back(done.unionByName(_encode_long(long, model, chunk, text, fan).select(done.columns)), every, "ids", "n_tokens", "round_trip")


def _encode_long(long: DataFrame, model: str, chunk: int, text: str, fan: int) -> DataFrame:
    side = 32

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_row", "k", "piece", "begin", "end"]
        for b in batches:
            for row, t in zip(b.column("_row").to_pylist(), b.column(text).to_pylist(), strict=True):
                s, rows = SPACE + t.replace(" ", SPACE), []
                for k, at in enumerate(range(0, len(s), chunk)):
                    left = min(at, side)
                    rows.append((row, k, s[at - left : at + chunk + side], left, min(left + chunk, left + len(s) - at)))
                for i in range(0, len(rows), 200):
                    cols = zip(*rows[i : i + 200], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=names)

    cut = long.select("_row", text).mapInArrow(pieces, "_row long, k int, piece string, begin int, end int")
    cut = written(cut.repartition(4 * shuffles(long.sparkSession), "_row", "k"), "pieces-chunks")

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model)
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("piece", "begin", "end")]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("k"), pa.array([_matrix(p, *x) for x in zip(*cols, strict=True)], pa.list_(pa.int32()))], names=["_row", "k", "pairs"])

    matrices = cut.mapInArrow(transfer, "_row long, k int, pairs array<int>")

    states = tree_states(matrices, fan)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model)
        for b in batches:
            raw = []
            for s, begin, end, i, j in zip(*[b.column(c).to_pylist() for c in ("piece", "begin", "end", "entry", "exit")], strict=True):
                entry = (0, 0) if i == START else (begin - 1 - i // 64, begin + i % 64)
                raw.append(_packed(p.path(s, entry, (end - 1 - j // 64, end + j % 64))))
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("k"), pa.array(raw, pa.binary())], names=["_row", "k", "raw"])

    traced = cut.join(states, ["_row", "k"]).mapInArrow(trace, "_row long, k int, raw binary")
    joined = traced.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("k", "raw"))).alias("parts")).select("_row", F.col("parts.raw").alias("_raw"))
    out = long.join(joined, "_row", "left").select(text, "_aside", "_raw")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(model)
        for b in batches:
            ids = [np.concatenate([_unpacked(x) for x in parts]) for parts in b.column("_raw").to_pylist()]
            same = [p.decode(x) == t for x, t in zip(ids, b.column(text).to_pylist(), strict=True)]
            listed = _listed([x.tobytes() for x in ids])
            yield pa.RecordBatch.from_arrays([b.column(text), b.column("_aside"), listed, pa.array(list(map(len, ids)), pa.int64()), pa.array(same)], names=[text, "_aside", "ids", "n_tokens", "round_trip"])

    return out.mapInArrow(check, out.select(text, "_aside").schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("round_trip", "boolean"))
