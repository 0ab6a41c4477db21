"""Content-addressed token store: texts become id streams, streams become chunks, equal chunks are stored once.

Layout under one folder on shared storage (all Parquet):

* ``objects/kind=chunk``: hash (SHA-256 of the packed ids), n, packed (little-endian ids of ``id_bytes`` bytes each);
* ``recipes``: one row per document in ascending doc_id order (``part`` numbers the files, ``place`` the rows of one): n_tokens, the chunk hashes in order, the Merkle root over them;
* ``manifests``: one row per part: documents, ids, and the Merkle root over the documents' roots;
* ``top``: one row: parts, documents, ids, and the Merkle root over the parts' roots.

Chunks end where a rolling sum of hashes of the last 16 ids has its high bits zero after mixing, so equal passages
give equal chunks wherever they start. A task drops chunks it has already sent, then one
shuffle on the hash brings equal chunks together, so a chunk that all documents share costs
one row per task; recipes are dealt evenly, whatever their root or id. Reading compares the
recipes with the manifests and these with the top row, in both directions, and verifies every
chunk hash and every Merkle root; anything lost or altered raises. A document's CRC is
combined from the CRCs of its chunks, so ids are not shuffled again.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import mix, tidied

_U = np.uint64
#: Chunks end where the hash of the last ROLL ids has its BITS high bits zero, and hold LEAST to MOST ids (a text's last may be shorter).
ROLL, BITS, LEAST, MOST = 16, 9, 64, 4096
#: Words whose ids a worker remembers.
CACHE_WORDS = 700_000
BLOCK_ROWS_BYTES = 4 << 20


#: 1: a-z; 2: ASCII punctuation without the apostrophe; 0: all else.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
for _low, _high in ((33, 39), (40, 48), (58, 65), (91, 97), (123, 127)):
    _CLASS[_low:_high] = 2


def split_marks(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and a space wherever a-z and punctuation meet, so that equal words repeat more often."""
    texts = pc.ascii_lower(texts).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    kind = _CLASS[raw]
    at = np.flatnonzero((kind[1:] | kind[:-1]) == 3) + 1
    at = at[kind[at] != kind[at - 1]]
    out = np.insert(raw, at, 32)
    moved = offsets + np.searchsorted(at, offsets, "left")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(moved.astype(np.int64)), pa.py_buffer(out))


#: The pre-tokenizer's pattern under which words can be encoded one by one (fixed value: that of the tokenizer file).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def joins_no_words(path: str) -> bool:
    """Whether a tokenizer file ignores case, drops white space and never joins letters with punctuation, so that words can be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    steps = lambda x, k: [] if not x else x[k] if x["type"] == "Sequence" else [x]
    normal = [(x["type"], x.get("pattern"), x.get("content")) for x in steps(parts["normalizer"], "normalizers")]
    before = steps(parts["pre_tokenizer"], "pretokenizers")
    split = [x for x in before if x["type"] == "Split"]
    rest = [x for x in before if x["type"] != "Split"]
    return (
        normal == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        and [(x["pattern"], x["behavior"], x["invert"]) for x in split] == [({"Regex": WORD_PATTERN}, "Removed", True)]
        and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rest)
        and not parts["post_processor"]
        and not any(parts["model"].get(k) for k in ("dropout", "continuing_subword_prefix"))
        and parts["model"].get("end_of_word_suffix") == "</w>"
    )


class WordEncoder:
    """Ids of texts through a ``tokenizers`` file.

    ``by_word`` is for tokenizers that ignore case, drop white space and never join letters
    with punctuation (None: as the file says): the text is then cut at white space and where ASCII letters and
    punctuation meet, and each piece is encoded once and remembered, which gives the ids of
    the whole text. Texts that may hold a special token are encoded whole.
    """

    def __init__(self, path: str, by_word: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        by_word = joins_no_words(path) if by_word is None else by_word
        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        probe = ["the", "zqxj", "internationalisation", "a"]
        #: Words of a-z pass the normalizer and the split as they are, so the model alone gives their ids.
        self.direct = by_word and [[t.id for t in self.tokenizer.model.tokenize(w)] for w in probe] == [e.ids for e in self.tokenizer.encode_batch_fast(probe, add_special_tokens=False)]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts

    def words(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``whole``, for words without white space; words of letters only take shorter ways."""
        found: list = [None] * len(names)
        rest, letters = [], []
        tokenize = self.tokenizer.model.tokenize
        for k, w in enumerate(names):
            if self.direct and w.isalpha():
                if w.isascii():
                    found[k] = [t.id for t in tokenize(w)]
                    continue
                if w.lower().isalpha():
                    letters.append(k)
                    continue
            rest.append(k)
        # Words of letters are one split each, and its last id ends a word: many can share one call.
        for a in range(0, len(letters), 512):
            part = letters[a : a + 512]
            ids = self.tokenizer.encode_batch_fast([" ".join(names[k] for k in part)], add_special_tokens=False)[0].ids
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(part) or stops[-1] != len(ids):
                rest += part
                continue
            begin = 0
            for k, stop in zip(part, stops, strict=True):
                found[k] = ids[begin:stop]
                begin = stop
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([names[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = e.ids
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's."""
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if not self.by_word or special.any():
            parts = [self.encode(texts.slice(k, 1)) if self.by_word and not special[k] else self.whole(texts.slice(k, 1).to_pylist()) for k in range(len(texts))]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        lists = pc.ascii_split_whitespace(split_marks(texts))
        coded = lists.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.index) > CACHE_WORDS:
            self.clear()
        own = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(own < 0)
        if len(new):
            missing = [names[k] for k in new.tolist()]
            own[new] = np.arange(len(self.index), len(self.index) + len(new))
            self.index.update(zip(missing, own[new].tolist(), strict=True))
            ids, counts = self.words(missing)
            self.flat = np.concatenate([self.flat, ids])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
        word = own[coded.indices.to_numpy()]
        first, size = self.bounds[word], self.bounds[word + 1] - self.bounds[word]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(first - total[:-1], size)]
        offsets = lists.offsets.to_numpy()
        return ids, np.diff(total[offsets - offsets[0]])


@cache
def encoder(path: str, by_word: bool | None) -> WordEncoder:
    return WordEncoder(path, by_word)


class Tree:
    """A binary SHA-256 tree over leaves that come one by one: inner nodes are marked, a last odd node moves up. Holds one node a level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        node = hashlib.sha256(b"\0" + leaf).digest()
        for k, left in enumerate(self.levels):
            if left is None:
                self.levels[k] = node
                return
            self.levels[k], node = None, hashlib.sha256(b"\1" + left + node).digest()
        self.levels.append(node)

    def root(self) -> bytes:
        """Of no leaves: the hash of nothing."""
        out = None
        for node in self.levels:
            if node is not None:
                out = node if out is None else hashlib.sha256(b"\1" + node + out).digest()
        return hashlib.sha256(b"").digest() if out is None else out


def merkle(leaves: list[bytes]) -> bytes:
    tree = Tree()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


@cache
def _id_values(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 2, dtype=_U))


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Chunk ends within each stream bounds[k]:bounds[k + 1] of ``ids``, the stream's end included."""
    sums = np.zeros(len(ids) + 1, _U)
    np.cumsum(_id_values(1 << int(ids.max()).bit_length())[ids] if len(ids) else ids, dtype=_U, out=sums[1:])
    marks = np.flatnonzero(((sums[ROLL:] - sums[:-ROLL]) * _U(0xD1342543DE82EF95)) >> _U(64 - BITS) == 0) + ROLL
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ends, begin = [], a
        low, high = np.searchsorted(marks, (a + ROLL, b))
        for m in marks[low:high].tolist():
            while m - begin > MOST:
                begin += MOST
                ends.append(begin)
            if m - begin >= LEAST:
                ends.append(m)
                begin = m
        while b - begin > MOST:
            begin += MOST
            ends.append(begin)
        if begin < b:
            ends.append(b)
        out.append(ends)
    return out


_OBJECTS = "kind string, route binary, deal int, doc_id long, n long, hashes array<binary>, packed binary"
_FIELDS = pa.schema([("kind", pa.string()), ("route", pa.binary()), ("deal", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.binary())), ("packed", pa.binary())])


def _encode(path: str, by_word: bool | None, end_id: int, id_bytes: int):
    kind = np.dtype(f"<u{id_bytes}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sent, dealt = encoder(path, by_word), set(), 0
        if max(len(tokens.ends) - 1, end_id + 1) > 1 << 8 * id_bytes:
            raise ValueError(f"ids of {path} do not fit in {id_bytes} bytes")
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy())
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BLOCK_ROWS_BYTES, "right")))
                ids, counts = tokens.encode(texts.slice(first, last - first))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                packed = ids.astype(kind).tobytes()
                rows: dict[str, list] = {f.name: [] for f in _FIELDS}
                for doc_id, begin, stop, chunk_ends in zip(batch.column(0).slice(first, last - first).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), cuts(ids, bounds), strict=True):
                    hashes, at = [], begin
                    for end in chunk_ends:
                        part = packed[at * id_bytes : end * id_bytes]
                        digest = hashlib.sha256(part).digest()
                        hashes.append(digest)
                        if digest not in sent:
                            if len(sent) > 1_000_000:
                                sent.clear()
                            sent.add(digest)
                            for name, value in zip(rows, ("chunk", digest, int.from_bytes(digest[:4], "little", signed=True), None, end - at, None, part), strict=True):
                                rows[name].append(value)
                        at = end
                    dealt += 1
                    for name, value in zip(rows, ("recipe", merkle(hashes), dealt, doc_id, stop - begin, hashes, None), strict=True):
                        rows[name].append(value)
                yield pa.RecordBatch.from_pydict(rows, schema=_FIELDS)
                first = last

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal chunks are in one partition: keep the first. The set holds a digest for each chunk of the partition."""
    seen = set()
    for batch in batches:
        keep = []
        for kind, route in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keep.append(kind == "recipe" or route not in seen)
            if kind == "chunk":
                seen.add(route)
        yield batch.filter(pa.array(keep, pa.bool_()))


_TOTALS = "part int, n_docs long, n_tokens long, root binary"
_COUNTED = f"{_TOTALS}, leaves long"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, n_docs, n_tokens, root), in order, to one row a part, with the number of its rows."""
    done: list[tuple] = []
    part, docs, tokens, leaves, tree = None, 0, 0, 0, Tree()
    for batch in batches:
        for own, d, n, root in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if own != part:
                if part is not None:
                    done.append((part, docs, tokens, tree.root(), leaves))
                part, docs, tokens, leaves, tree = own, 0, 0, 0, Tree()
            docs, tokens, leaves = docs + d, tokens + n, leaves + 1
            tree.add(root)
    if part is not None:
        done.append((part, docs, tokens, tree.root(), leaves))
    kinds = {"part": pa.int32(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "root": pa.binary(), "leaves": pa.int64()}
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds.values())], list(kinds))


def _part_totals(recipes: DataFrame) -> DataFrame:
    """What the manifests hold, from the recipes; a part is a file of bounded size."""
    rows = recipes.select("part", F.lit(1).cast("long").alias("n_docs"), "n_tokens", "root", "place")
    return rows.repartition("part").sortWithinPartitions("part", "place").drop("place").mapInArrow(_totals, _COUNTED).drop("leaves")


def _top_totals(manifests: DataFrame) -> DataFrame:
    """The top row, from the manifests: a row for each file, one after the other."""
    rows = manifests.withColumn("all", F.lit(0)).repartitionByRange(1, "part").sortWithinPartitions("part")
    found = rows.select("all", "n_docs", "n_tokens", "root").mapInArrow(_totals, _COUNTED)
    return found.select(F.col("leaves").alias("n_parts"), "n_docs", "n_tokens", "root")


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_bytes: int = 2, by_word: bool | None = None) -> None:
    """Encode every whole text of ``docs`` (doc_id, text; null: empty) and write the store to ``folder``.

    ``id_bytes`` must hold every id of the tokenizer (2 for vocabularies up to 65,536, else 4); otherwise it raises.
    An empty text is the end id alone. Repeated rows of one id are documents of their own, in
    the order of their roots; null ids come first. No rows: a store without rows.
    """
    spark = docs.sparkSession
    objects = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(_encode(tokenizer, by_word, end_id, id_bytes)), _OBJECTS)
    placed = objects.repartition("deal").mapInArrow(tidied(_once), _OBJECTS).drop("deal")
    placed.write.partitionBy("kind").option("compression", "lz4").parquet(f"{folder}/objects")
    # Equal rows are told apart by where they were read, so that many of them still fill several parts.
    order = [F.col("doc_id").asc_nulls_first(), F.col("root"), F.col("tie")]
    recipes = _objects(spark, folder).where("kind = 'recipe'").select("doc_id", F.col("n").alias("n_tokens"), "hashes", F.col("route").alias("root"), F.monotonically_increasing_id().alias("tie"))
    numbered = recipes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    numbered = numbered.withColumns({"part": F.shiftright("row", 33).cast("int"), "place": F.expr("row & ((1L << 33) - 1)")}).drop("row", "tie")
    numbered.write.parquet(f"{folder}/recipes")
    _part_totals(_recipes(spark, folder)).write.parquet(f"{folder}/manifests")
    _top_totals(_manifests(spark, folder)).write.parquet(f"{folder}/top")


def _objects(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("route binary, doc_id long, n long, hashes array<binary>, packed binary, kind string").parquet(f"{folder}/objects")


def _recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, hashes array<binary>, root binary, part int, place long").parquet(f"{folder}/recipes")


def _manifests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_TOTALS).parquet(f"{folder}/manifests")


def verify_store(spark: SparkSession, folder: str) -> None:
    """Raise where recipes, manifests and the top row do not agree, or one is lost."""

    def same(x: DataFrame, y: DataFrame, keys: list[str], what: str) -> None:
        other = y.select(*(F.col(c).alias(f"_{c}") for c in y.columns))
        meet = F.lit(True)
        for k in keys:
            meet = meet & (F.col(k) == F.col(f"_{k}"))
        differ = F.lit(False)
        for c in x.columns:
            differ = differ | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        found = x.join(other, meet, "full").where(differ).limit(1).collect()
        if found:
            raise ValueError(f"{what} are damaged: {found[0].asDict()}")

    top = spark.read.schema("n_parts long, n_docs long, n_tokens long, root binary").parquet(f"{folder}/top")
    if not top.limit(1).count() and not _recipes(spark, folder).limit(1).count() and not _manifests(spark, folder).limit(1).count():
        return  # a store without rows
    same(_part_totals(_recipes(spark, folder)), _manifests(spark, folder), ["part"], "recipes")
    same(_top_totals(_manifests(spark, folder)), top, ["root"], "manifests")


_POLYNOMIAL = 0xEDB88320


def _times(matrix: list[int], vector: int) -> int:
    out = k = 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


@cache
def _doubling(k: int) -> tuple[list[int], ...]:
    """Four tables, one per byte of a CRC, that carry it over the 2**k bytes that follow."""
    one = [_POLYNOMIAL] + [1 << i for i in range(31)]  # over one bit
    for _ in range(3 + k):
        one = [_times(one, x) for x in one]
    out = []
    for s in range(0, 32, 8):
        table = [0] * 256
        for b in range(1, 256):
            table[b] = table[b & (b - 1)] ^ one[s + (b & -b).bit_length() - 1]
        out.append(table)
    return tuple(out)


def crc_join(first: int, second: int, length: int) -> int:
    """CRC-32 of a sequence from those of its two parts; the second part has ``length`` bytes."""
    k = 0
    while length:
        if length & 1:
            a, b, c, d = _doubling(k)
            first = a[first & 255] ^ b[first >> 8 & 255] ^ c[first >> 16 & 255] ^ d[first >> 24]
        length >>= 1
        k += 1
    return first ^ second


def _check_chunks(id_bytes: int):
    kind = np.dtype(f"<u{id_bytes}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc = [], []
            for digest, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(packed).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                n.append(len(packed) // id_bytes)
                crc.append(zlib.crc32(np.frombuffer(packed, kind).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["hash", "chunk_n", "crc"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, crcs = [], []
        for root, n, chunks in zip(*(batch.column(k).to_pylist() for k in (1, 2, 4)), strict=True):
            chunks = sorted(chunks, key=lambda c: c["pos"])
            if any(c["crc"] is None for c in chunks):
                raise ValueError(f"a chunk of the document of root {root.hex()} is damaged: it is missing")
            if n != sum(c["chunk_n"] for c in chunks) or merkle([c["hash"] for c in chunks]) != root:
                raise ValueError(f"document of root {root.hex()} is damaged")
            crc = 0
            for c in chunks:
                crc = crc_join(crc, c["crc"], 4 * c["chunk_n"])
            totals.append(sum(c["chunk_n"] for c in chunks))
            crcs.append(crc)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(totals, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, folder: str, id_bytes: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; lost or damaged chunks, recipes or manifests raise."""
    verify_store(spark, folder)
    recipes = _recipes(spark, folder)
    before = _manifests(spark, folder).select("part", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each file
    order = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = recipes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(before, "part")
    steps = starts.select("part", "place", "doc_id", "n_tokens", "root", (F.col("before") + F.col("inside")).alias("start"), F.posexplode("hashes").alias("pos", "hash"))
    chunks = _objects(spark, folder).where("kind = 'chunk'").select(F.col("route").alias("hash"), "packed").mapInArrow(tidied(_check_chunks(id_bytes)), "hash binary, chunk_n long, crc long")
    whole = _assembled(steps.join(chunks, "hash", "left"), ["root", "n_tokens", "start"], F.struct("pos", "hash", "chunk_n", "crc"))
    return whole.mapInArrow(tidied(_assemble), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _assembled(steps: DataFrame, facts: list[str], chunk) -> DataFrame:
    """doc_id, facts and the chunks of every document."""
    whole = steps.groupBy("part", "place").agg(F.first("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in facts), F.collect_list(chunk).alias("chunks"))
    return whole.select("doc_id", *facts, "chunks")


def documents(spark: SparkSession, folder: str, id_bytes: int = 2) -> DataFrame:
    """doc_id and ids (array of int) of every document of the store; what is lost or damaged raises."""
    verify_store(spark, folder)
    chunks = _objects(spark, folder).where("kind = 'chunk'").select(F.col("route").alias("hash"), "packed")
    steps = _recipes(spark, folder).select("part", "place", "doc_id", "n_tokens", "root", F.posexplode("hashes").alias("pos", "hash")).join(chunks, "hash", "left")
    kind = np.dtype(f"<u{id_bytes}")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for root, n, parts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                packed = [c["packed"] for c in sorted(parts, key=lambda c: c["pos"])]
                if None in packed or merkle([hashlib.sha256(x).digest() for x in packed]) != root or n != sum(map(len, packed)) // id_bytes:
                    raise ValueError(f"document of root {root.hex()} is damaged")
                out.append(np.frombuffer(b"".join(packed), kind).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _assembled(steps, ["root", "n_tokens"], F.struct("pos", "packed")).mapInArrow(join, "doc_id long, ids array<int>")
