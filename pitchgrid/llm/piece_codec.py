"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding gives the ids of the SentencePiece library for a byte-fallback BPE model with a dummy prefix and no other
normalisation. That encoding is a path problem: a sequence of pieces is the encoding of its text exactly when the merges of
each two neighbours, taken alone, give these two pieces. So a path over the text has weight 0 if all its neighbours agree and
minus infinity otherwise, and one path of weight 0 remains (merge ranks themselves don't add up along a path).

Texts of up to ``CHUNK`` characters are encoded in one piece. A longer one is cut every ``CHUNK`` characters, at any place,
even inside a piece. The state at a cut is the piece that reaches it: how many characters it has before and after the cut. A
chunk is a transfer matrix from entry states to exit states; kept sparse, it is the set of (entry, exit) pairs of weight 0.
Matrices combine associatively in the max-plus semiring (``combine``). A scan in grouped rounds does so: upwards, ``FAN``
neighbouring matrices of a text become one, until one is left of each text; downwards, the entry and exit state of a block
give those of its members. No group holds more than ``FAN`` matrices, however long the text is, and the rounds grow with the
logarithm of its length. Each chunk is then traced back on its own. Only matrices, never texts, meet by text.

Within a chunk, no piece continues past a U+2581 that follows another character, so paths meet there: words are segmented
once and kept in a bounded cache, and a matrix needs the ragged ends only. Texts without such places are handled, slower.

Defined cases: a null text gives null ids, an empty text none; U+2581 in a text is encoded by its bytes, so decoding always
returns the text; rows equal in id and text are encoded once and get equal results; an empty table gives an empty result;
columns named like a result are replaced.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchgrid.llm.storage import in_small_batches, materialised

CHUNK = 32_768
#: Matrices combined in one group of a round.
FAN = 8
SPACE = "▁"
LATIN = "A-Za-z\u00c0-\u024f"
CACHED_WORDS, CACHED_PAIRS, CACHED_LENGTH = 120_000, 40_000, 32
NONE = float("-inf")


#: Weights by (entry, exit) state; what isn't there has weight minus infinity.
Matrix = dict[tuple[int, int], float]
MATRIX = T.ArrayType(T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("leave", T.IntegerType()), T.StructField("weight", T.DoubleType())]))


def combine(left: Matrix, right: Matrix) -> Matrix:
    """Max-plus product of two transfer matrices."""
    after: dict[int, list[tuple[int, float]]] = {}
    for (entry, leave), weight in right.items():
        after.setdefault(entry, []).append((leave, weight))
    out: Matrix = {}
    for (entry, middle), first in left.items():
        for leave, then in after.get(middle, ()):
            out[entry, leave] = max(first + then, out.get((entry, leave), NONE))
    return out


def states(matrices: list[Matrix], entry: int = 0, leave: int = 0) -> list[tuple[int, int]]:
    """(entry, exit) state of each of some neighbouring matrices on the best path between two states; of equal paths the one of least states."""
    best, came = {entry: 0.0}, []
    for m in matrices:
        found: dict[int, tuple[float, int]] = {}
        for (here, there), weight in sorted(m.items()):
            if here in best and (there not in found or best[here] + weight > found[there][0]):
                found[there] = (best[here] + weight, here)
        came.append(found)
        best = {there: weight for there, (weight, _) in found.items()}
    out = []
    for found in reversed(came):
        out.append((found[leave][1], leave))
        leave = found[leave][1]
    return out[::-1]


class Codec:
    """Segmentation over the pieces of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores: dict[str, float] = {}
        self.ids: dict[str, bytes] = {}
        self.table: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.table.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.table.append(b"")
            else:
                self.scores[piece], self.ids[piece] = model.get_score(i), np.int32(i).tobytes()
                self.table.append(piece.replace(SPACE, " ").encode())
        if not any(model.is_byte(i) for i in range(model.get_piece_size())):
            raise ValueError("the model has no byte pieces, so it can't encode every text")
        self.reach = max(map(len, self.scores))
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.word = re.compile(self._unit_pattern(), re.S)
        self.literal = self._bytes_of(SPACE)
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _unit_pattern(self) -> str:
        """A pattern of the longest strings that no place where paths meet divides, by what the model's pieces hold."""
        if not self.splits:
            return ".+"
        if any(re.search(f"[{LATIN}][^{LATIN}{SPACE}]", p) for p in self.scores):
            return f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        return f"{SPACE}+[^{SPACE}{LATIN}]*[{LATIN}]*|[^{SPACE}{LATIN}]+[{LATIN}]*|[{LATIN}]+"  # a letter ends, too, before other characters

    def _bytes_of(self, text: str) -> bytes:
        return self.byte_ids[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes()

    def _ids_of(self, pieces: list[str]) -> bytes:
        known = self.ids.get
        return b"".join([known(p) or self._bytes_of(p) for p in pieces])

    def merged(self, s: str) -> list[str]:
        """The pieces of a short string by repeated merges, best score first, leftmost among equals."""
        parts, score = list(s), self.scores.get
        gain = [score(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while gain and (most := max(gain)) > NONE:
            k = gain.index(most)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del gain[k]
            if k:
                gain[k - 1] = score(parts[k - 1] + parts[k], NONE)
            if k < len(gain):
                gain[k] = score(parts[k] + parts[k + 1], NONE)
        return parts

    def _agree(self, a: str, b: str) -> bool:
        """Whether the merges of a + b give a and b (a empty: of b give b)."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def _path(self, s: str, starts_below: int, before: str = "") -> list[int]:
        """For every end in s the start of the last piece on the path of weight 0, -1 if there is none.

        before is the piece in front of s; pieces start below starts_below.
        """
        n, scores, reach = len(s), self.scores, self.reach
        last = [0] + [-1] * n
        for j in range(1, n + 1):
            for i in range(max(0, j - reach), min(j, starts_below)):
                if (i and last[i] < 0) or (j - i > 1 and s[i:j] not in scores):
                    continue
                if self._agree(s[last[i] : i] if i else before, s[i:j]):
                    last[j] = i
                    break
        return last

    def _traced(self, s: str, last: list[int], end: int) -> list[str]:
        out = []
        while end:
            out.append(s[last[end] : end])
            end = last[end]
        return out[::-1]

    def _word(self, word: str) -> bytes:
        """Ids of a word; the cache's younger half takes in what it lacks."""
        if len(word) > CACHED_LENGTH:
            return self._ids_of(self._traced(word, self._path(word, len(word)), len(word)))
        if got := self.words.get(word):
            return got
        if len(self.words) >= CACHED_WORDS // 2:
            self.words, self.older_words = {}, self.words
        got = self.words[word] = self.older_words.get(word) or self._ids_of(self.merged(word))
        return got

    def _marked(self, s: str) -> bytes:
        """Ids of a string of pieces' characters that no piece enters or leaves."""
        known, word = self.words.get, self._word
        return b"".join([known(w) or word(w) for w in self.word.findall(s)])

    def marked(self, text: str) -> list[str]:
        """The text as strings of pieces' characters between literal U+2581."""
        first, *rest = text.split(SPACE)
        return [(SPACE + first if text else "").replace(" ", SPACE), *[x.replace(" ", SPACE) for x in rest]]

    def encode(self, text: str) -> bytes:
        """Ids of a text as int32 bytes."""
        return self.literal.join([self._marked(s) for s in self.marked(text)])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        table = self.table
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text

    # Chunks: s is up to reach characters before a chunk (front of them), the chunk's own, and up to reach - 1 after it (from
    # stop on). State (b, a) of a cut, as b * reach + a: the piece that reaches it has b characters before and a after it.
    # State 0 is the start or the end of the whole string.

    def _entry(self, s: str, front: int, state: int) -> tuple[str, int]:
        """The piece of an entry state and the place after it."""
        b, a = divmod(state, self.reach)
        return s[front - b : front + a], front + a

    def entries(self, s: str, front: int) -> list[int]:
        """States that the cut in front of a chunk can have."""
        if not front:
            return [0]
        near = range(1, min(self.reach, front) + 1)
        found = [(b, a) for b in near for a in range(min(self.reach - b, len(s) - front) + 1)]
        return [b * self.reach + a for b, a in found if b + a == 1 or s[front - b : front + a] in self.scores]

    def _exits(self, last: list[int], at: int, stop: int, n: int) -> list[int]:
        """Exit states of the paths in s[at:] that last describes."""
        if stop == n:
            return [0] if last[n - at] >= 0 else []
        out = []
        for j in range(stop, min(stop + self.reach, n + 1)):
            if j > at and last[j - at] >= 0 and last[j - at] + at < stop:
                out.append((stop - last[j - at] - at) * self.reach + j - stop)
        return out

    def _meets(self, s: str, low: int, high: int) -> tuple[int, int] | None:
        """First and last place from low to high where every path has an end."""
        if not self.splits:
            return None
        found = [m.end() for m in re.finditer(f"[^{SPACE}](?={SPACE})", s[: high + 1]) if low <= m.end() <= high]
        return (found[0], found[-1]) if found else None

    def matrix(self, s: str, front: int, stop: int) -> Matrix:
        """The chunk's transfer matrix."""
        n = len(s)
        meets = self._meets(s, front + self.reach, stop - 1)
        upto = meets[0] if meets else n
        ends = [] if meets is None else self._exits(self._path(s[meets[1] :], stop - meets[1]), meets[1], stop, n)
        out: Matrix = {}
        for state in self.entries(s, front):
            before, at = self._entry(s, front, state)
            if before and not self._agree("", before):
                continue
            last = self._path(s[at:upto], (upto if meets else stop) - at, before)
            if meets is None:
                out |= {(state, x): 0.0 for x in self._exits(last, at, stop, n)}
            elif last[-1] >= 0:
                out |= {(state, x): 0.0 for x in ends}
        return out

    def chunk_ids(self, s: str, front: int, stop: int, entry: int, leave: int) -> bytes:
        """Ids of the pieces that start in the chunk, on the path between two states."""
        before, at = self._entry(s, front, entry)
        end = stop + leave % self.reach if leave else len(s)
        meets = self._meets(s, at, stop - 1)
        if meets is None:
            return self._ids_of(self._traced(s[at:end], self._path(s[at:end], stop - at, before), end - at))
        first, tail = meets
        head = self._traced(s[at:first], self._path(s[at:first], first - at, before), first - at)
        rest = s[tail:end]
        return self._ids_of(head) + self._marked(s[first:tail]) + self._ids_of(self._traced(rest, self._path(rest, stop - tail), end - tail))


class Unigram:
    """Transfer matrices of a Unigram model: a path weighs the sum of its pieces' scores; the best path wins.

    States are those of ``Codec``. A piece counts in the chunk where it starts. A character without a piece of its own is one of
    the score ``unknown``. Of equally good paths the one whose pieces start earliest is taken, piece by piece from the end.
    """

    def __init__(self, scores: dict[str, float], unknown: float) -> None:
        self.scores, self.unknown, self.reach = scores, unknown, max(map(len, scores))

    def _score(self, piece: str) -> float:
        return self.scores.get(piece, self.unknown if len(piece) == 1 else NONE)

    def _best(self, s: str, at: int, stop: int) -> dict[int, tuple[float, int]]:
        """For every place that pieces from at on reach, starting below stop: the best weight and the start of its last piece."""
        best = {at: (0.0, at)}
        for i in range(at, stop):
            if i in best:
                for j in range(i + 1, min(i + self.reach, len(s)) + 1):
                    weight = best[i][0] + self._score(s[i:j])
                    if weight > max(NONE, best.get(j, (NONE, 0))[0]):
                        best[j] = (weight, i)
        return best

    def entries(self, s: str, front: int) -> list[int]:
        """States that the cut in front of a chunk can have."""
        if not front:
            return [0]
        found = [(b, a) for b in range(1, min(self.reach, front) + 1) for a in range(min(self.reach - b, len(s) - front) + 1)]
        return [b * self.reach + a for b, a in found if self._score(s[front - b : front + a]) > NONE]

    def matrix(self, s: str, front: int, stop: int) -> Matrix:
        """The chunk's transfer matrix; s, front and stop as for ``Codec``."""
        out: Matrix = {}
        for state in self.entries(s, front):
            at = front + state % self.reach
            best = self._best(s, at, stop)
            if stop == len(s):
                if stop in best:
                    out[state, 0] = best[stop][0]
                continue
            for i in (x for x in best if x < stop):
                for j in range(stop, min(i + self.reach, len(s)) + 1):
                    if self._score(s[i:j]) > NONE:
                        out[state, (stop - i) * self.reach + j - stop] = best[i][0] + self._score(s[i:j])
        return out

    def chunk_pieces(self, s: str, front: int, stop: int, entry: int, leave: int) -> list[str]:
        """The pieces that start in the chunk, on the path between two states."""
        at, out = front + entry % self.reach, []
        best, end = self._best(s, at, stop), len(s)
        if leave:
            i = stop - leave // self.reach
            out, end = [s[i : stop + leave % self.reach]], i
        while end > at:
            start = best[end][1]
            out.append(s[start:end])
            end = start
        return out[::-1]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a model file, once per Python process."""
    return Codec(path)


def _matrix(stored: list[dict]) -> Matrix:
    return {(x["entry"], x["leave"]): x["weight"] for x in stored}


def _stored(m: Matrix) -> list[dict]:
    return [{"entry": e, "leave": x, "weight": w} for (e, x), w in sorted(m.items())]


@F.arrow_udf(MATRIX)
def _product(members: pa.Array) -> pa.Array:
    """The product of each list of members (k, m)."""
    return pa.array([_stored(reduce(combine, [_matrix(x["m"]) for x in row])) for row in members.to_pylist()], pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("weight", pa.float64())])))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("k", "entry", "leave")])))
def _member_states(members: pa.Array, entry: pa.Array, leave: pa.Array) -> pa.Array:
    """The states of each member (k, m) of a block between two states."""
    out = []
    for row, e, x in zip(members.to_pylist(), entry.to_pylist(), leave.to_pylist(), strict=True):
        found = states([_matrix(y["m"]) for y in row], e, x)
        out.append([{"k": y["k"], "entry": a, "leave": b} for y, (a, b) in zip(row, found, strict=True)])
    return pa.array(out, pa.list_(pa.struct([("k", pa.int32()), ("entry", pa.int32()), ("leave", pa.int32())])))


def scan(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """(id, key, part, k, entry, leave): the states of matrices(id, key, part, k, m), from state 0 to state 0 of each (id, key, part)."""
    of = ["id", "key", "part"]
    blocks, top = [], matrices.agg(F.max("k")).first()[0] or 0
    while True:
        members = matrices.groupBy(*of, F.floor(F.col("k") / fan).cast("int").alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("members"))
        blocks.append(materialised(members))
        top //= fan
        if not top:
            break
        matrices = blocks[-1].select(*of, "k", _product("members").alias("m"))
    at = blocks[-1].withColumn("entry", F.lit(0)).withColumn("leave", F.lit(0))
    for below in [*reversed(blocks[:-1]), None]:
        at = at.select(*of, F.explode(_member_states("members", "entry", "leave")).alias("s")).select(*of, "s.*")
        if below is not None:
            same = below["id"].eqNullSafe(at["id"]) & (below["key"] == at["key"]) & (below["part"] == at["part"]) & (below["k"] == at["k"])
            at = below.join(at, same).select(*[below[c] for c in [*of, "k", "members"]], at["entry"], at["leave"])
    return at


def _id_array(parts: list[bytes | None]) -> pa.ListArray:
    """Lists of int32 from their bytes."""
    offsets = np.concatenate(([0], np.cumsum([len(p or b"") // 4 for p in parts]))).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(p or b"" for p in parts), np.int32), pa.int32())
    null = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=null)


def _chunk_table(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    """(id, key, part, k, s, front, stop) for the chunks of each text; part counts the strings between literal U+2581."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                rows = []
                for part, s in enumerate(c.marked(text)):
                    # the last chunk holds at least reach characters, so that no piece jumps over it
                    cuts = [x for x in range(0, max(len(s), 1), chunk) if x == 0 or len(s) - x >= c.reach]
                    for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(s)], strict=True)):
                        low = max(0, a - c.reach)
                        rows.append((part, k, s[low : b + c.reach - 1], a - low, b - low))
                for at in range(0, len(rows), 256):
                    columns = list(zip(*rows[at : at + 256], strict=True))
                    of = pa.array([i] * len(columns[0]), pa.int64())
                    own = [pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *own], ["id", "key", "part", "k", "s", "front", "stop"])

    kind = T.StructType([T.StructField("id", giants.schema["id"].dataType), T.StructField("key", T.LongType()), T.StructField("part", T.IntegerType()),
                         T.StructField("k", T.IntegerType()), T.StructField("s", T.StringType()), T.StructField("front", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    return giants.select("id", "key", "text").mapInArrow(cut, kind).repartition("id", "key", "part", "k")


def _encode_giants(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    """(id, key, ids) of each distinct text of giants(id, key, text)."""
    chunks = materialised(_chunk_table(giants.dropDuplicates(["id", "key"]), path, chunk))
    place = ["id", "key", "part", "k"]

    @F.arrow_udf(MATRIX)
    def matrix(s: pa.Array, front: pa.Array, stop: pa.Array) -> pa.Array:
        c = codec(path)
        rows = zip(*(a.to_pylist() for a in (s, front, stop)), strict=True)
        return pa.array([_stored(c.matrix(*row)) for row in rows], pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("weight", pa.float64())])))

    at = scan(chunks.select(*place, matrix("s", "front", "stop").alias("m")))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def trace(s: pa.Array, front: pa.Array, stop: pa.Array, entry: pa.Array, leave: pa.Array) -> pa.Array:
        c = codec(path)
        return _id_array([c.chunk_ids(*x) for x in zip(*(a.to_pylist() for a in (s, front, stop, entry, leave)), strict=True)])

    same = [chunks["id"].eqNullSafe(at["id"]), *[chunks[c] == at[c] for c in ("key", "part", "k")]]
    traced = chunks.join(at, same).select(*[chunks[c] for c in place], trace("s", "front", "stop", "entry", "leave").alias("ids"))
    literal = F.array(*[F.lit(i).cast("int") for i in np.frombuffer(codec(path).literal, np.int32).tolist()])
    traced = traced.withColumn("ids", F.when((F.col("k") == 0) & (F.col("part") > 0), F.concat(literal, "ids")).otherwise(F.col("ids")))
    parts = F.array_sort(F.collect_list(F.struct("part", "k", "ids")))
    return traced.groupBy("id", "key").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, verify: bool = False
) -> DataFrame:
    """docs without text_col, with ``ids`` (array of int), ``n_tokens`` and ``text_key`` (XXH64 of the text).

    verify: also ``round_trip``, whether decoding the ids gives the text (null for a null text).
    """
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens", "text_key", text_col, *["round_trip"] * verify)]
    text = F.col(text_col).cast("string")
    rows = in_small_batches(docs).select(*kept, F.col(id_col).alias("__pg_id"), text.alias("__pg_text"), F.xxhash64(text).alias("text_key"))
    long = F.coalesce(F.length("__pg_text") > chunk, F.lit(False))

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def encoded(text: pa.Array) -> pa.Array:
        c, texts = codec(model_path), text.to_pylist()
        ids = [None if x is None else c.encode(x) for x in texts]
        same = [None if x is None else c.decode(np.frombuffer(i, np.int32)) == x if verify else None for x, i in zip(texts, ids, strict=True)]
        return pa.StructArray.from_arrays([_id_array(ids), pa.array(same, pa.bool_())], ["ids", "round_trip"])

    checked = ["round_trip"] * verify
    short = rows.where(~long).select(*kept, "text_key", encoded("__pg_text").alias("__pg_e")).select(*kept, "text_key", "__pg_e.ids", *[f"__pg_e.{c}" for c in checked])
    giants = rows.where(long)
    done = _encode_giants(giants.select(F.col("__pg_id").alias("id"), F.col("text_key").alias("key"), F.col("__pg_text").alias("text")), model_path, chunk)
    done = done.toDF("__pg_i", "__pg_k", "ids")
    same = F.col("__pg_id").eqNullSafe(F.col("__pg_i")) & (F.col("text_key") == F.col("__pg_k"))
    if verify:
        back = decode(done, model_path, "__pg_back").select("__pg_i", "__pg_k", "ids", F.xxhash64("__pg_back").alias("__pg_b"))
        done = back.withColumn("round_trip", F.col("__pg_b") == F.col("__pg_k")).drop("__pg_b")
    joined = giants.drop("__pg_text").join(done, same).select(*kept, "text_key", "ids", *checked)
    return short.unionByName(joined).withColumn("n_tokens", F.size("ids").cast("bigint"))


def decode(encoded: DataFrame, model_path: str, to: str = "text") -> DataFrame:
    """encoded with the text of its ids in column to."""

    @F.arrow_udf(T.StringType())
    def decoded(ids: pa.Array) -> pa.Array:
        c = codec(model_path)
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        return pa.array([c.decode(values[a:b]) if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)], pa.string())

    return encoded.withColumn(to, decoded("ids"))


def encode_and_check(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): the ids, and whether decoding them gives the text back."""
    done = encode(docs.select(id_col, text_col), model_path, id_col, text_col, verify=True)
    return done.select(F.col(id_col).alias("doc_id"), "n_tokens", "ids", "round_trip")
