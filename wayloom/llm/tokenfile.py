"""Token-ID files: documents as token ids in blocks under a static range asymmetric numeral system.

Texts are dealt out by ranges of (doc_id, hash of the text) and sorted, so that partitions hold ascending ids and a hot id
is still spread. Each task encodes its texts with a public tokenizer and cuts the stream, at document ends, into blocks of
at least ``BLOCK_TOKENS`` tokens (a longer document is one block). The token counts of all blocks give one shared
frequency table of 2^``SCALE_BITS`` slots (at most one entry per vocabulary id, which bounds it), and every block is
encoded on its own under it:

* token i of a block belongs to lane i mod ``lanes``; each lane is a coder with a 64-bit state that moves 32-bit words. All lanes
  take one step at a time, and their words are interleaved in lane order, so that coding is a few array operations a step.
* every ``CHECKPOINT_STEPS`` steps a checkpoint keeps the lanes' states, the place in the words and the checksum of the tokens
  up to the next one: a section between checkpoints can be decoded alone, and a reader of one document decodes its sections only.
* a checksum over the payload and the checksum of the frequency table guard the block.

The files are Parquet folders, so that any store of Spark's can hold them, commits are atomic and lost executors are replaced:
``table`` (one row: symbols, frequencies, checksum) and ``blocks`` (start, doc_ids, lengths, payload, n_tokens, table_crc).

The tokenizer is split off the texts' white space: a word between ASCII white space is encoded once per worker and kept (up to
``CACHE_WORDS`` words), which gives the ids of the whole text as long as the tokenizer drops white space and joins nothing
across it; ``whole_texts`` turns this off.

Defined results: null and empty texts have the end id alone; null doc_ids come first; rows that repeat an id stand side
by side in the order of their text's hash; a damaged block yields its documents with null crc and an error text; an empty table
gives files without blocks.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from wayloom.llm.common import drop_tables, keep_table

END_ID = 1
SCALE_BITS = 18
BLOCK_TOKENS = 1 << 20
LANES = 2048
CHECKPOINT_STEPS = 128
CACHE_WORDS = 3 << 19
#: Punctuation that ends a word without any rule of its own; the apostrophe has some.
PUNCTUATION = ".,;:!?\"()$%&*-"
#: Bytes of text whose words are looked up together.
TEXTS_AT_ONCE = 1 << 23
FORMAT = b"rANS\x01"
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)

_tokenizers: dict[int, Words] = {}


class Words:
    """A tokenizer with a pool of the ids of the words it has met.

    Texts are split at ASCII white space and their distinct words looked up. A word of letters with trailing punctuation is
    two words to the tokenizer, and case is of no account where it lower-cases. New words of letters are encoded together,
    as one text, and told apart by the tokens that end a word, if the tokenizer marks them; where the number of ends
    does not fit, and for all other words, each is encoded by itself.
    """

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab()
        size = max(max(vocabulary.values(), default=0), END_ID) + 1
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        self.ends = np.zeros(size, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.lowers = '"Lowercase"' in json.dumps(json.loads(spec).get("normalizer"))
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        #: Ids of word i stand at ``bounds[i]`` up to ``bounds[i + 1]`` of the pool.
        self.pool, self.bounds = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.pool = np.concatenate([self.pool, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])

    def places(self, words: pa.Array, letters: np.ndarray) -> np.ndarray:
        """Numbers of distinct words in the pool; new ones are encoded, ``letters`` says which are of letters alone."""
        listed = words.cast(pa.binary()).to_pylist()
        get = self.known.get
        found = np.fromiter((get(w, -1) for w in listed), np.int64, len(listed))
        fresh = np.flatnonzero(found < 0)
        plain = [listed[i] for i in fresh[letters[fresh]].tolist()]
        single = [listed[i] for i in fresh[~letters[fresh]].tolist()]
        if plain:
            ids = self._encode([b" ".join(plain).decode()])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(plain) and stops[-1] == len(ids):
                self._add(plain, ids, np.diff(stops, prepend=0))
            else:
                single += plain
        if single:
            each = self._encode([w.decode() for w in single])
            self._add(single, np.concatenate(each), np.array([len(x) for x in each]))
        found[fresh] = [self.known[listed[i]] for i in fresh.tolist()]
        return found

    def ids(self, texts: pa.StringArray, whole: bool = False) -> list[bytes]:
        """Ids of every text, with the end id."""
        texts = texts.fill_null("")
        if whole:
            return [found.tobytes() + self.end for found in self._encode(texts.to_pylist())]
        if len(self.known) > CACHE_WORDS:
            self.forget()
        split = pc.ascii_split_whitespace(texts)
        occurring = split.flatten().dictionary_encode()
        words = occurring.dictionary
        cores = pc.ascii_rtrim(words, PUNCTUATION)
        # Words that stay words of letters whatever the tokenizer's normal form and case do to them.
        letters = pc.utf8_is_alpha(cores).to_numpy(zero_copy_only=False) & bool(self.ends.any())
        foreign = np.flatnonzero(letters & ~pc.string_is_ascii(cores).to_numpy(zero_copy_only=False))
        letters[foreign] = [unicodedata.is_normalized("NFC", w) and w.lower().isalpha() for w in cores.take(pa.array(foreign)).to_pylist()]
        heads = pc.if_else(pa.array(letters), pc.ascii_lower(cores) if self.lowers else cores, words)
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False)
        tailed = np.flatnonzero(letters & (pc.binary_length(cores).to_numpy(zero_copy_only=False) < lengths))
        tails = [w[len(w.rstrip(PUNCTUATION)) :] for w in words.take(pa.array(tailed)).to_pylist()]
        distinct = heads.dictionary_encode()
        number = distinct.indices.to_numpy()
        of_letters = np.zeros(len(distinct.dictionary), bool)
        of_letters[number[letters]] = True
        head_at = self.places(distinct.dictionary, of_letters)[number]
        tail_words = pa.array(tails, pa.string()).dictionary_encode()
        tail_at = np.full(len(words), -1, np.int64)
        if tails:
            tail_at[tailed] = self.places(tail_words.dictionary, np.zeros(len(tail_words.dictionary), bool))[tail_words.indices.to_numpy()]
        # The ids of each distinct word, head and tail in one piece, as a binary value; those of all words are then taken from these.
        start = np.stack([self.bounds[head_at], self.bounds[np.maximum(tail_at, 0)]], axis=1)
        size = np.stack([self.bounds[head_at + 1], np.where(tail_at < 0, self.bounds[0], self.bounds[tail_at + 1])], axis=1) - start
        size[tail_at < 0, 1] = 0
        starts, sizes = start.ravel(), size.ravel()
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        data = self.pool[np.arange(total) + np.repeat(starts - stops + sizes, sizes)]
        ends = np.concatenate([[0], stops[1::2]]) * data.itemsize
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        stream = values.take(occurring.indices)
        bytes_of = memoryview(stream.buffers()[2] or b"")
        place = np.frombuffer(stream.buffers()[1], np.int64)[: len(stream) + 1] if len(stream) else np.zeros(1, np.int64)
        upto = place[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [bytes(bytes_of[lo:hi]) + self.end for lo, hi in zip(upto, upto[1:], strict=False)]


def _words(spec: str) -> Words:
    """One tokenizer per worker process."""
    key = hash(spec)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Words(spec)
    return _tokenizers[key]


class Table:
    """Shared frequency table: symbols, their share of 2^``SCALE_BITS`` slots, and the slot each begins at."""

    def __init__(self, symbols: np.ndarray, shares: np.ndarray) -> None:
        self.symbols, self.shares = symbols.astype(np.uint32), shares.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.shares)[:-1]]).astype(np.uint64) if len(symbols) else self.shares
        self.crc = zlib.crc32(self.symbols.astype("<u4").tobytes() + self.shares.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> Table:
        """Shares in proportion to counts, at least one slot each; what rounding leaves over or lacks is settled by the largest."""
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order].astype(np.float64)
        slots = 1 << SCALE_BITS
        shares = np.maximum(1, np.floor(counts / max(1.0, counts.sum()) * slots)).astype(np.int64)
        gap = slots - int(shares.sum())
        for i in np.argsort(-shares, kind="stable"):
            if not gap:
                break
            step = gap if gap > 0 else max(gap, 1 - int(shares[i]))
            shares[i] += step
            gap -= step
        return cls(symbols, shares)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share and first slot of every id."""
        size = int(self.symbols[-1]) + 1 if len(self.symbols) else 1
        shares, starts = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        shares[self.symbols], starts[self.symbols] = self.shares, self.starts
        return shares[ids], starts[ids]

    def slots(self) -> np.ndarray:
        """Per slot, in one number: place in its symbol's share (lowest bits), the share (up to all slots), the symbol."""
        number = np.repeat(np.arange(len(self.symbols)), self.shares.astype(np.int64))
        inside = np.arange(len(number), dtype=np.uint64) - self.starts[number]
        packed = (self.symbols.astype(np.uint64)[number] << np.uint64(2 * SCALE_BITS + 1)) | (self.shares[number] << np.uint64(SCALE_BITS)) | inside
        return packed


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """Payload of a block of ids."""
    lanes = int(min(lanes, max(1, len(ids) // 64)))
    steps = -(-len(ids) // lanes)
    share, begin = table.of(ids)
    state = np.full(lanes, LOW, np.uint64)
    shift, scale = np.uint64(63 - SCALE_BITS), np.uint64(SCALE_BITS)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    emitted = 0
    for step in range(steps - 1, -1, -1):
        f, c = share[step * lanes : (step + 1) * lanes], begin[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= f << shift
        out = x[full]
        if len(out):
            words.append(out.astype(np.uint32))
            emitted += len(out)
            x[full] = out >> WORD
        q = x // f
        x[:] = (q << scale) + (x - q * f) + c
        if step % CHECKPOINT_STEPS == 0:
            marks.append((emitted, state.copy()))
    marks.reverse()
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    size = CHECKPOINT_STEPS * lanes
    places = np.array([emitted - left for left, _ in marks], "<u8")
    sums = np.array([zlib.crc32(ids[i * size : (i + 1) * size].astype("<u4").tobytes()) for i in range(len(marks))], "<u4")
    head = np.array([lanes, CHECKPOINT_STEPS, len(ids), len(marks), len(stream)], "<u4").tobytes()
    states = b"".join(s.astype("<u8").tobytes() for _, s in marks)
    body = head + places.tobytes() + sums.tobytes() + states + stream.astype("<u4").tobytes()
    return FORMAT + zlib.crc32(body).to_bytes(4, "little") + body


class Block:
    """A payload, ready to decode any of its sections."""

    def __init__(self, payload: bytes, table: Table) -> None:
        if payload[: len(FORMAT)] != FORMAT:
            raise ValueError("not a block of token ids")
        body = memoryview(payload)[len(FORMAT) + 4 :]
        if zlib.crc32(body) != int.from_bytes(payload[len(FORMAT) : len(FORMAT) + 4], "little"):
            raise ValueError("checksum of the block differs")
        self.table = table
        self.lanes, every, self.n, marks, n_words = np.frombuffer(body, "<u4", 5).tolist()
        self.size = every * self.lanes
        at = 20
        self.places = np.frombuffer(body, "<u8", marks, at)
        self.sums = np.frombuffer(body, "<u4", marks, at + 8 * marks)
        self.states = np.frombuffer(body, "<u8", marks * self.lanes, at + 12 * marks).reshape(marks, self.lanes)
        self.words = np.frombuffer(body, "<u4", n_words, at + 12 * marks + 8 * marks * self.lanes)

    def section(self, nth: int, slots: np.ndarray) -> np.ndarray:
        """Ids between a checkpoint and the next one."""
        count = min(self.size, self.n - nth * self.size)
        out = np.empty(count, np.uint32)
        state = self.states[nth].astype(np.uint64)
        at = int(self.places[nth])
        mask, share_mask, scale, above = np.uint64((1 << SCALE_BITS) - 1), np.uint64((2 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(2 * SCALE_BITS + 1)
        for first in range(0, count, self.lanes):
            x = state[: min(self.lanes, count - first)]
            entry = slots[x & mask]
            out[first : first + len(x)] = entry >> above
            x[:] = ((entry >> scale) & share_mask) * (x >> scale) + (entry & mask)
            low = x < LOW
            n = int(np.count_nonzero(low))
            if n:
                x[low] = (x[low] << WORD) | self.words[at : at + n]
                at += n
        if zlib.crc32(out.astype("<u4").tobytes()) != int(self.sums[nth]):
            raise ValueError("checksum of the tokens differs")
        return out

    def ids(self, slots: np.ndarray, first: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from place ``first`` up to ``stop``; only the sections that hold them are decoded."""
        stop = self.n if stop is None else stop
        if stop <= first:
            return np.zeros(0, np.uint32)
        begin = first // self.size
        parts = [self.section(i, slots) for i in range(begin, (stop - 1) // self.size + 1)]
        return np.concatenate(parts)[first - begin * self.size : stop - begin * self.size]


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` bytes of text (column 1), or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size)))
        yield batch.slice(start, stop - start)
        start = stop


def token_blocks(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", whole_texts: bool = False, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(part, base, doc_ids, lengths, ids) in ascending order of id: base is the number of tokens before the block in its part."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    text = F.col(text_col).cast("string")
    # The row number spreads rows of one id and text, whose order is of no account.
    keys = docs.select(F.col(id_col).alias("key"), F.xxhash64(text).alias("code"), (F.monotonically_increasing_id() % 1024).alias("spread"), text.alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(n, F.col("key").asc_nulls_first(), "code", "spread").sortWithinPartitions(F.col("key").asc_nulls_first(), "code", "spread")
    kind = dealt.schema["key"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _words(shared.value)
        width = np.dtype(coder.dtype).itemsize
        key_type: pa.DataType | None = None
        keys_, lengths, ids = [], [], []
        held = base = 0

        def flush() -> pa.RecordBatch:
            row = [pa.array([base], pa.int64()), pa.array([keys_], pa.list_(key_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([b"".join(ids)], pa.large_binary())]
            return pa.RecordBatch.from_arrays(row, ["base", "doc_ids", "lengths", "ids"])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for part in _slices(batch, TEXTS_AT_ONCE):
                found = coder.ids(part.column(1), whole_texts)
                for key, one in zip(part.column(0).to_pylist(), found, strict=True):
                    keys_.append(key)
                    lengths.append(len(one) // width)
                    ids.append(one)
                    held += lengths[-1]
                    if held >= block_tokens:
                        yield flush()
                        base += held
                        held, keys_, lengths, ids = 0, [], [], []
        if keys_:
            yield flush()

    blocks = dealt.select("key", "text").mapInArrow(cut, f"base long, doc_ids array<{kind.simpleString()}>, lengths array<long>, ids binary")
    return blocks.select(F.spark_partition_id().alias("part"), "*")


def count_tokens(blocks: DataFrame, dtype: type) -> Table:
    """Frequency table of all tokens; one row per distinct id reaches the driver, as many as the vocabulary has at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                found = np.bincount(np.frombuffer(ids.as_buffer(), dtype))
                if len(found) > len(total):
                    total, found = found.astype(np.int64), total
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return Table.of_counts(rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", whole_texts: bool = False, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write ``folder``/table and ``folder``/blocks; ``tokenizer`` is the path of a tokenizers file on the driver."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    dtype = _words(spec).dtype
    blocks = keep_table(token_blocks(docs, spec, id_col, text_col, whole_texts, block_tokens))
    table = count_tokens(blocks, dtype)
    spark.createDataFrame([(table.symbols.tolist(), table.shares.astype(np.int64).tolist(), table.crc)], "symbols array<long>, shares array<long>, crc long").write.parquet(f"{folder}/table")
    sizes = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)
    # One row per shuffle partition.
    parts = blocks.select("part", sizes.alias("n")).groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    offsets, done = {}, 0
    for row in parts:
        offsets[row["part"]] = done
        done += row["n"]
    shared = spark.sparkContext.broadcast((table, offsets))
    kind = blocks.schema["doc_ids"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offsets = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = np.frombuffer(row.column(4)[0].as_buffer(), dtype)
                start = offsets[row.column(0)[0].as_py()] + row.column(1)[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), row.column(2), row.column(3), pa.array([table.crc], pa.int64()), pa.array([encode_block(ids, table)], pa.large_binary())],
                    ["start", "n_tokens", "doc_ids", "lengths", "table_crc", "payload"],
                )

    coded = blocks.mapInArrow(encode, f"start long, n_tokens long, doc_ids {kind}, lengths array<long>, table_crc long, payload binary")
    coded.write.parquet(f"{folder}/blocks")
    drop_tables(blocks)


def read_table(spark: SparkSession, folder: str) -> Table:
    row = spark.read.parquet(f"{folder}/table").first()
    table = Table(np.array(row["symbols"], np.int64), np.array(row["shares"], np.int64))
    if table.crc != row["crc"]:
        raise ValueError("checksum of the frequency table differs")
    return table


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False, wanted: Column | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, error (and ids) of every document, decoded from the files.

    ``wanted``, a condition on doc_id, decodes only the sections of the documents that meet it.
    """
    table = read_table(spark, folder)
    shared = spark.sparkContext.broadcast(table)
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind: ArrayType = blocks.schema["doc_ids"].dataType
    columns = "start long, n_tokens long, ids_crc32 long, error string" + (", ids array<long>" if with_ids else "")
    chosen = F.transform("doc_ids", lambda x: F.lit(True))
    if wanted is not None:
        place = F.posexplode_outer("doc_ids").alias("nth", "doc_id")
        picked = blocks.select("start", place).filter(wanted).groupBy("start").agg(F.collect_set("nth").alias("picked"))
        blocks = blocks.join(picked, "start")
        chosen = F.transform("doc_ids", lambda x, i: F.array_contains("picked", i))
    rows = blocks.select("start", "doc_ids", "lengths", "table_crc", "payload", chosen.alias("chosen"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        slots = table.slots()
        for batch in batches:
            for i in range(batch.num_rows):
                start, lengths, crc = batch.column(0)[i].as_py(), batch.column(2)[i].values.to_numpy(), batch.column(3)[i].as_py()
                keep = np.flatnonzero(batch.column(5)[i].values.to_numpy(zero_copy_only=False))
                ends = np.cumsum(lengths)
                sums: list[int | None] = []
                tokens: list[np.ndarray | None] = []
                error = None
                try:
                    if crc != table.crc:
                        raise ValueError("another frequency table")
                    block = Block(batch.column(4)[i].as_py(), table)
                    every = block.ids(slots) if len(keep) == len(lengths) else None
                    for d in keep.tolist():
                        first, stop = int(ends[d] - lengths[d]), int(ends[d])
                        ids = every[first:stop] if every is not None else block.ids(slots, first, stop)
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        tokens.append(ids.astype(np.int64) if with_ids else None)
                except ValueError as damaged:
                    error = str(damaged)
                    sums, tokens = [None] * len(keep), [None] * len(keep)
                arrays = [batch.column(1)[i].values.take(pa.array(keep)), pa.array(start + ends[keep] - lengths[keep]), pa.array(lengths[keep]), pa.array(sums, pa.int64()), pa.array([error] * len(keep), pa.string())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "error"]
                if with_ids:
                    arrays.append(pa.array(tokens, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(decode, f"doc_id {kind.elementType.simpleString()}, {columns}")
