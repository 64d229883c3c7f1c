"""Operator 9: token ids in a content-addressed store."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from functools import lru_cache
from hashlib import blake2b
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import batches
from weftline.session import kept, remove, shared_dir

#: A chunk ends where MEAN divides the rolling hash of its last MEMORY ids, or after MOST ids.
MEAN, MEMORY, MOST = 256, 8, 2048
#: Documents of a recipe shard, about.
SHARD_DOCS = 50_000
#: Shards whose sizes are added up in one task.
BLOCK = 1000
#: Units that a task remembers from step to step, slots that its table has at first, and new units that are added together.
REMEMBER, SLOTS, AT_ONCE = 1_500_000, 1 << 22, 1 << 18
#: Texts with one of these go through the library whole: other white space, letters whose lower case depends on what stands around, special strings.
RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u0130\u03a3\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Fixed value: the pre-tokens of the vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pre-tokens that go through the library in one text.
TOGETHER = 500
CODEC = {"compression": "zstd"}


class WordEncoder:
    """Encodes texts with a tokenizers file of lower-case words with word ends.

    Its pre-tokens never cross white space and each ends with a token marked
    as such, so a text's ids are those of its units, and units can be encoded
    together and told apart again. Each distinct unit goes through the library
    once, until the table is full; units are looked up by a 64-bit hash and
    compared byte by byte with what the table holds.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n.get("type") for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or not spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"not a lower-case vocabulary with word ends: {path}")
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != SPLIT:
            raise ValueError(f"other pre-tokens than are known here: {path}")
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.width = np.dtype("<u2") if max(vocab.values()) < 1 << 16 else np.dtype("<u4")
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        suffix = spec["model"]["end_of_word_suffix"]
        self.last[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        """Starts the table anew: from the hash of a unit to its number, ids of all units one behind the other."""
        self.known = batches.Numbers(SLOTS)
        self.count = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.spelled = batches.Spelling()

    def store(self, units: list[str], simple: np.ndarray) -> np.ndarray:
        """Numbers of new units, whose ids are kept. Simple ones are one pre-token each and go through the library together."""
        one = np.flatnonzero(simple).tolist()
        lines = [" ".join([units[k] for k in one[a : a + TOGETHER]]) for a in range(0, len(one), TOGETHER)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)), np.int32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(one):
            raise ValueError("words of this vocabulary can't be told apart")
        count = np.zeros(len(units), np.int64)
        count[one] = np.diff(ends, prepend=0)
        parts = [ids]
        other = np.flatnonzero(~simple).tolist()
        for k, e in zip(other, self.tokenizer.encode_batch_fast([units[k] for k in other], add_special_tokens=False) if other else [], strict=True):
            count[k] = len(e.ids)
            parts.append(np.array(e.ids, np.int32))
        order = np.concatenate([one, other]).astype(np.int64)
        first = np.empty(len(units), np.int64)
        first[order] = np.cumsum(count[order]) - count[order] + len(self.flat)
        number = len(self.count) + np.arange(len(units), dtype=np.int32)
        self.flat = np.concatenate([self.flat, *parts])
        self.count, self.first = np.append(self.count, count), np.append(self.first, first)
        self.spelled.add([u.encode() for u in units])
        return number

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """Ids of each text and the end id."""
        odd, plain = {}, []
        for k, t in enumerate(texts):
            if not t or "<|" in t or RARE.search(t) or not (t.isascii() or is_normalized("NFC", t)):
                odd[k] = t or ""
                plain.append(b"")
            else:
                plain.append(t.lower().encode())
        flat = np.frombuffer(b"\n".join(plain) + b"\n", np.uint8)
        edge = np.cumsum([0, *(len(p) + 1 for p in plain)])
        begin, stop, h, simple = units_of(flat)
        if len(self.count) > REMEMBER:
            self.forget()
        number = self.known.find(h)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            new, at = np.unique(h[fresh], return_index=True)
            at = fresh[at]
            raw = flat.tobytes()
            for k in range(0, len(new), AT_ONCE):
                some = at[k : k + AT_ONCE]
                units = [raw[a:b].decode() for a, b in zip(begin[some].tolist(), stop[some].tolist(), strict=True)]
                self.known.add(new[k : k + AT_ONCE], self.store(units, simple[some]))
            number[fresh] = self.known.find(h[fresh])
        other = self.spelled.differ(number, flat, begin, stop - begin)
        if len(other):  # units with the hash of another one
            raw = flat.tobytes()
            number[other] = self.store([raw[a:b].decode() for a, b in zip(begin[other].tolist(), stop[other].tolist(), strict=True)], simple[other])
        own = self.count[number]
        last = np.cumsum(own)
        total = int(last[-1]) if len(last) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.first[number] - (last - own), own)].astype(self.width)
        cut = np.concatenate([[0], last])[np.searchsorted(begin, edge)].tolist()
        done = dict(zip(odd, self.tokenizer.encode_batch_fast(list(odd.values()), add_special_tokens=False), strict=True)) if odd else {}
        return [np.append(np.array(done[k].ids, self.width) if k in done else ids[cut[k] : cut[k + 1]], self.width.type(end)) for k in range(len(texts))]


def kinds() -> np.ndarray:
    """Kind of each byte of lower-case text: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 beyond ASCII."""
    out = np.full(256, 4, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c in " \n\t\r" else 1 if c.isalpha() else 2 if c.isdigit() else 3
    return out


KINDS = kinds()
LETTER_HASH = np.random.default_rng(9).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)


def units_of(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, hash and simplicity of the units of a text.

    A word of ASCII and Latin-1 letters without an apostrophe is cut into its
    pre-tokens: runs of letters, runs of marks and single digits. Such a unit
    is simple; any other word is one unit as it stands.
    """
    kind = KINDS[flat]
    lead = np.flatnonzero(flat[:-1] == 0xC3)
    lead = lead[(flat[lead + 1] != 0x97) & (flat[lead + 1] != 0xB7)]
    kind[lead] = 1
    kind[lead + 1] = 1
    inside = np.flatnonzero(kind)
    if not len(inside):
        return inside, inside, np.empty(0, np.uint64), np.empty(0, bool)
    k, b = kind[inside], flat[inside]
    gap = np.ones(len(inside), bool)
    gap[1:] = inside[1:] != inside[:-1] + 1
    word = np.flatnonzero(gap)
    whole = np.logical_or.reduceat((k == 4) | (b == 39), word)
    split = np.zeros(len(inside), bool)
    split[1:] = (k[1:] != k[:-1]) | (k[1:] == 2)
    if whole.any():
        split &= ~np.repeat(whole, np.diff(np.append(word, len(inside))))
    new = gap | split
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(inside)))
    place = np.arange(len(inside)) - np.repeat(start, size)
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    h = np.add.reduceat(LETTER_HASH[b] * power[place], start)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    h[h == 0] = 1
    begin = inside[start]
    simple = np.ones(len(start), bool)
    if whole.any():
        simple = ~whole[np.searchsorted(word, start, side="right") - 1]
    return begin, begin + size, h, simple


def load(path: str) -> WordEncoder:
    return batches.only(("token_store", path), lambda: WordEncoder(path))


def cut_ids(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream, by content: a hash of the last MEMORY ids that is 0 modulo MEAN, and every MOST ids after the last end."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    for k in (1, 2, 4):
        x[k:] = x[k:] + (x[:-k] * np.uint64(0xBF58476D1CE4E5B9) ** np.uint64(k) if len(x) > k else 0)
    ends = (np.flatnonzero((x >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1).tolist()
    out, last = [], 0
    for e in [*ends, len(ids)]:
        out += range(last + MOST, e, MOST)
        if e > last:
            out.append(e)
        last = e
    return out


def digest(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves in order: pairs are hashed level by level, an odd last one goes up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[k : k + 2])) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0]


def chunk_rows(df: DataFrame, path: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, idx, digest, n, ids) of every chunk; ids is null where a task has given the same chunk before."""
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))

    def make():
        model = load(path)
        given: set[bytes] = set()

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            owner, idx, digests, count, held = [], [], [], [], []
            if len(given) > REMEMBER // 4:
                given.clear()
            for k, ids in enumerate(model.encode(part.column("text").to_pylist(), end)):
                at = 0
                for i, e in enumerate(cut_ids(ids)):
                    raw = ids[at:e].tobytes()
                    d = digest(raw)
                    owner.append(k)
                    idx.append(i)
                    digests.append(d)
                    count.append(e - at)
                    held.append(None if d in given else raw)
                    given.add(d)
                    at = e
            take = pa.array(owner, pa.int64())
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(take), part.column("row").take(take), pa.array(idx, pa.int32()), pa.array(digests, pa.binary()), pa.array(count, pa.int32()), pa.array(held, pa.binary())],
                ["doc_id", "row", "idx", "digest", "n", "ids"],
            )

        return step

    return batches.map_steps(src, make, f"doc_id {kind}, row bigint, idx int, digest binary, n int, ids binary")


def sealed(key, part):
    """The manifest's row of one shard, from its recipes."""
    import pandas as pd

    part = part.sort_values(["doc_id", "row"], na_position="first")
    return pd.DataFrame({"shard": [key[0]], "docs": [len(part)], "n_tokens": [int(part["n_tokens"].sum())], "root": [merkle(part["root"].tolist())]})


def write(df: DataFrame, path: str, to: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the store of a table of documents into the folder `to` and returns it.

    chunks/ (digest, ids): each distinct chunk once, ids as little-endian
    unsigned numbers of 2 bytes (4 if the vocabulary needs them). recipes/
    (doc_id, row, n_tokens, chunks, root, shard): of each document its chunk
    digests in order and their Merkle root, in ascending order of doc_id (null
    first, then repeated rows as read), cut into shards. manifest/ (shard,
    docs, n_tokens, root, width): the Merkle root over the documents of each
    shard, and the bytes of an id. A null text counts as empty; each document
    ends with the id `end`; other columns are not read.
    """
    spark = df.sparkSession
    staged = f"{to}/staged"
    chunk_rows(df, path, end, id_col, text_col).write.options(**CODEC).parquet(staged)
    rows = spark.read.parquet(staged)
    rows.where("ids is not null").select("digest", "ids").groupBy("digest").agg(F.first("ids").alias("ids")).write.options(**CODEC).parquet(f"{to}/chunks")
    own = rows.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("idx", "digest", "n"))).alias("held"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def rooted(parts):
        for part in parts:
            held = part.column("held").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("row"),
                    pa.array([sum(h["n"] for h in own) for own in held], pa.int64()),
                    pa.array([[h["digest"] for h in own] for own in held], pa.list_(pa.binary())),
                    pa.array([merkle([h["digest"] for h in own]) for own in held], pa.binary()),
                ],
                ["doc_id", "row", "n_tokens", "chunks", "root"],
            )

    recipes = own.mapInArrow(rooted, f"doc_id {kind}, row bigint, n_tokens bigint, chunks array<binary>, root binary")
    shards = max(1, -(-rows.where("idx = 0").count() // SHARD_DOCS))
    # rows that repeat an id, or have none, fill as many shards as they need
    recipes.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").withColumn("shard", F.spark_partition_id()).write.options(**CODEC).parquet(f"{to}/recipes")
    remove(spark, staged)

    spark.read.parquet(f"{to}/recipes").select("shard", "doc_id", "row", "n_tokens", "root").groupBy("shard").applyInPandas(sealed, "shard int, docs bigint, n_tokens bigint, root binary").withColumn("width", F.lit(load(path).width.itemsize)).write.parquet(f"{to}/manifest")
    return to


#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def times(matrix: list[int], vector: int) -> int:
    total = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            total ^= row
        vector >>= 1
    return total


@lru_cache(maxsize=4096)
def zeros(n: int) -> list[int]:
    """The matrix that appends n zero bytes to a CRC-32."""
    power = [POLYNOMIAL, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):
        power = [times(power, r) for r in power]
    out = [1 << k for k in range(32)]
    while n:
        if n & 1:
            out = [times(power, r) for r in out]
        power = [times(power, r) for r in power]
        n >>= 1
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of byte strings one behind the other, from (size, crc) of each."""
    crc = 0
    for size, own in parts:
        crc = times(zeros(size), crc) ^ own
    return crc


def width_of(spark: SparkSession, store: str) -> int:
    """Bytes of an id, as the manifest of a store names them."""
    named = spark.read.parquet(f"{store}/manifest").agg(F.min("width"), F.max("width")).first()
    if named[0] != named[1]:
        raise ValueError("shards of one store have ids of different width")
    return named[0] or 4


def read_chunks(spark: SparkSession, store: str, width: int) -> DataFrame:
    """(digest, n, crc) of the stored chunks, as read from their ids. Fails on a chunk whose ids don't have its digest."""

    def run(parts):
        for part in parts:
            digests, held = part.column("digest").to_pylist(), part.column("ids").to_pylist()
            crc = []
            for d, raw in zip(digests, held, strict=True):
                if digest(raw) != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
                crc.append(zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([len(r) // width for r in held], pa.int32()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    return spark.read.parquet(f"{store}/chunks").mapInArrow(run, "digest binary, n int, crc bigint")


def sound_shards(spark: SparkSession, store: str) -> DataFrame:
    """(shard, n_tokens) of the manifest. Fails on a recipe whose chunk digests don't have its root, and on a shard whose recipes don't have the documents, tokens and root that the manifest names."""

    def rooted(parts):
        for part in parts:
            for doc, chunks, root in zip(part.column("doc_id").to_pylist(), part.column("chunks").to_pylist(), part.column("root").to_pylist(), strict=True):
                if merkle(chunks or []) != root:
                    raise ValueError(f"the recipe of document {doc} is damaged")
            yield part.select(["shard", "doc_id", "row", "n_tokens", "root"])

    def same(key, part, named):
        if len(part) and len(named) == 1:
            own, told = sealed(key, part).iloc[0], named.iloc[0]
            if own["docs"] == told["docs"] and own["n_tokens"] == told["n_tokens"] and own["root"] == told["root"]:
                return named[["shard", "n_tokens"]]
        raise ValueError(f"shard {key[0]} is damaged: its recipes and the manifest differ")

    recipes = spark.read.parquet(f"{store}/recipes").select("shard", "doc_id", "row", "n_tokens", "root", "chunks")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    checked = recipes.mapInArrow(rooted, f"shard int, doc_id {kind}, row bigint, n_tokens bigint, root binary")
    return checked.groupBy("shard").cogroup(spark.read.parquet(f"{store}/manifest").groupBy("shard")).applyInPandas(same, "shard int, n_tokens bigint")


def shard_offsets(shards: DataFrame) -> DataFrame:
    """(shard, offset): ids in all shards before each. Summed in two steps, so no task has all shards: within blocks of BLOCK shards, and over blocks."""
    shards = shards.withColumn("block", F.floor(F.col("shard") / BLOCK))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = shards.groupBy("block").agg(F.sum("n_tokens").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(blocks, "block").select("shard", (F.col("ahead") + F.col("within")).alias("offset"))


def summary(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a store.

    start is the number of ids of all documents before it; ids_crc32 is taken
    over all its ids as little-endian unsigned 32-bit numbers, put together
    from the chunks that its recipe names. A recipe that names a chunk the
    store doesn't have, or other ids than it counts, fails, as does one that
    differs from its root or a shard that differs from the manifest.
    """
    recipes = spark.read.parquet(f"{store}/recipes")
    offsets = shard_offsets(sound_shards(spark, store))
    inside = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select("doc_id", "row", "n_tokens", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within")).join(offsets, "shard")
    named = recipes.select("row", F.posexplode("chunks").alias("pos", "digest"))
    parts = named.join(read_chunks(spark, store, width_of(spark, store)), "digest", "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))).alias("parts"))

    def run(batch):
        for part in batch:
            crc, count = [], []
            for own in part.column("parts").to_pylist():
                if any(p["n"] is None for p in own):
                    raise ValueError("a recipe names a chunk that the store doesn't have")
                crc.append(joined_crc([(4 * p["n"], p["crc"]) for p in own]))
                count.append(sum(p["n"] for p in own))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(count, pa.int64()), pa.array(crc, pa.int64())], ["row", "held", "ids_crc32"])

    checked = parts.mapInArrow(run, "row bigint, held bigint, ids_crc32 bigint")
    return placed.join(checked, "row").select(
        "doc_id",
        (F.col("offset") + F.col("within")).alias("start"),
        F.when(F.col("held") == F.col("n_tokens"), F.col("held")).otherwise(F.raise_error(F.lit("a recipe counts other ids than its chunks hold")).cast("long")).alias("n_tokens"),
        "ids_crc32",
    )


def read(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, row, ids) of every document, put together again from chunks and recipes. Fails on whatever summary() fails on."""
    kind = f"<u{width_of(spark, store)}"

    def sound(batch):
        for part in batch:
            for d, raw in zip(part.column("digest").to_pylist(), part.column("ids").to_pylist(), strict=True):
                if digest(raw) != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
            yield part

    @F.pandas_udf("array<bigint>")
    def numbers(parts, n):
        out = []
        for own, size in zip(parts, n, strict=True):
            if any(p["ids"] is None for p in own):
                raise ValueError("a recipe names a chunk that the store doesn't have")
            out.append(np.frombuffer(b"".join(p["ids"] for p in own), kind).astype(np.int64))
            if len(out[-1]) != size:
                raise ValueError("a recipe counts other ids than its chunks hold")
        return pd.Series(out)

    import pandas as pd

    recipes = spark.read.parquet(f"{store}/recipes").join(sound_shards(spark, store).select("shard"), "shard")
    named = recipes.select("doc_id", "row", "n_tokens", F.posexplode("chunks").alias("pos", "digest"))
    chunks = spark.read.parquet(f"{store}/chunks").select("digest", "ids").mapInArrow(sound, "digest binary, ids binary")
    return named.join(chunks, "digest", "left").groupBy("doc_id", "row", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts")).select("doc_id", "row", numbers("parts", "n_tokens").alias("ids"))


def new_store(spark: SparkSession) -> str:
    """A folder for a store that release() deletes."""
    return kept(spark, f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}")
