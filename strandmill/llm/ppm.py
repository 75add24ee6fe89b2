"""Language-model scores by prediction by partial matching over bytes, pretrained on the corpus.

The trie of byte contexts up to ``ORDER`` bytes is held as tables of (context, symbol) counts, one per order.  A symbol is
coded in the longest context; where it has not been seen there, an escape (method D: half a count is taken
from each distinct symbol of the context) leads to the next shorter one, from which all symbols already
offered are excluded.  After the empty context, what is left of the alphabet is equally likely.  Byte 255, which
UTF-8 never uses, stands before a text as context and after it as its end.

Texts are packed into blocks of about ``BLOCK`` bytes, written once.  A block asks for each distinct (context, symbol) and
each distinct token in it, not for each occurrence; counts are summed over all blocks, turned into log-probabilities by
joins, and sent back to the blocks that asked.  So no task holds the model and what is gathered
grows with the corpus.

Nulls: a null text is empty (its only token is the end); a null id is learnt from.  Repeated rows count and are
scored each for itself.  Empty tables give an empty result.  Tokens and contexts are told apart by 64-bit hashes
and exact codes respectively.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandmill.llm import tokens
from strandmill.llm.scratch import save

ORDER, BLOCK, SLICE = 4, 32_000_000, 500_000
#: Codes that wait before they are merged with those of the block so far.
MERGE = 500_000
END_TOKEN = 1  # hash of the end of a text among token hashes
GRAM, TOKEN = 0, 1


def pack(docs: DataFrame) -> DataFrame:
    """``docs`` (id, t, held) as blocks: (block, ids, held, sizes, blob), the blob compressed."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        number, rows, held_bytes = TaskContext.get().partitionId() << 12, [], 0
        squeeze = zstandard.ZstdCompressor(level=1)

        def emit():
            data = b"".join(r[2] for r in rows)
            cols = [pa.array([number], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(id_type)), pa.array([[r[1] for r in rows]], pa.list_(pa.bool_())), pa.array([[len(r[2]) for r in rows]], pa.list_(pa.int64())), pa.array([squeeze.compress(data)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "held", "sizes", "blob"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, h, t in zip(batch.column("id").to_pylist(), batch.column("held").to_pylist(), batch.column("t"), strict=True):
                data = (t.as_buffer().to_pybytes() if t.is_valid else b"")
                rows.append((i, bool(h), data))
                held_bytes += len(data) + 64
                if held_bytes >= BLOCK:
                    yield emit()
                    number, rows, held_bytes = number + 1, [], 0
        if rows:
            yield emit()

    return docs.mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, sizes array<long>, blob binary")


def _pieces(sizes: np.ndarray, blob: bytes):
    """(first document, last, bytes, offsets) of a block, half a megabyte at a time: its codes take a hundred times as much."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8) if len(blob) else np.zeros(0, np.uint8)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def gram_codes(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, text of each) of every symbol with the ``order`` bytes before it, the end of the text included."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + n * (order + 1), 255, np.uint8)
    padded[np.arange(len(data)) + text * (order + 1) + order] = data
    codes = np.zeros(len(padded) - order if len(padded) else 0, np.int64)
    for k in range(order + 1):
        codes <<= 8
        codes |= padded[k : k + len(codes)]
    # Codes that start in a text's padding and end there belong to no symbol.
    sizes = np.diff(offsets) + 1
    of = np.repeat(np.arange(n), sizes)
    first = offsets[:-1] + np.arange(n) * (order + 1)
    places = first[of] + np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes)
    return codes[places], of


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each) of the words and the ends of texts."""
    starts, ends, before = tokens.words(data, offsets)
    words = tokens.word_hashes(data, starts, ends).view(np.int64)
    n = len(offsets) - 1
    of = np.concatenate((np.repeat(np.arange(n), np.diff(before)), np.arange(n)))
    return np.concatenate((words, np.full(n, END_TOKEN, np.int64))), of


def _count(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def requests(blocks: DataFrame, order: int) -> DataFrame:
    """(kind, code, block, train): what each block asks for and how often its training documents hold it."""

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                held = np.array(batch.column("held")[row].as_py(), bool)
                sizes = np.array(batch.column("sizes")[row].as_py(), np.int64)
                found: dict[int, list] = {GRAM: [], TOKEN: []}
                for a, b, data, offsets in _pieces(sizes, batch.column("blob")[row].as_py()):
                    for kind, (codes, of) in ((GRAM, gram_codes(data, offsets, order)), (TOKEN, token_hashes(data, offsets))):
                        out = held[a:b][of]
                        found[kind].append(tuple(np.unique(codes[~out], return_counts=True)))
                        asked = np.unique(codes[out])
                        found[kind].append((asked, np.zeros(len(asked), np.int64)))
                        if sum(len(p[0]) for p in found[kind][1:]) > max(MERGE, len(found[kind][0][0])):
                            found[kind] = [_count(found[kind])]
                for kind, parts in found.items():
                    codes, counts = _count(parts)
                    for k in range(0, len(codes), 100_000):
                        part = codes[k : k + 100_000]
                        cols = [pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(np.full(len(part), batch.column("block")[row].as_py(), np.int64)), pa.array(counts[k : k + 100_000])]
                        yield pa.RecordBatch.from_arrays(cols, names=["kind", "code", "block", "train"])

    return blocks.select("block", "held", "sizes", "blob").mapInArrow(run, "kind int, code long, block long, train long")


def log_probabilities(grams: DataFrame, order: int) -> DataFrame:
    """(code, value) for ``grams`` (code, c): log10 probability of each code's last byte after its other bytes.

    ``c`` is the training count; codes with c = 0 are wanted but unseen.
    """
    shorter = lambda c, k: c.bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))  # noqa: E731  the code with k context bytes
    counts = {order: save(grams.where("c > 0"), "ppm-counts")}
    for k in range(order - 1, -1, -1):
        table = counts[k + 1].groupBy(shorter(F.col("code"), k).alias("code")).agg(F.sum("c").alias("c"))
        counts[k] = save(table, "ppm-counts") if k >= order - 2 else table
    nodes = {}
    for k in range(order, -1, -1):
        context = F.shiftright("code", 8).alias("ctx")
        if k:
            below = counts[k - 1].select(F.col("code").alias("low"), F.col("c").alias("below"))
            rows = counts[k].withColumn("low", shorter(F.col("code"), k - 1)).join(below, "low").select(context, "c", "below")
        else:
            rows = counts[k].select(context, "c", F.lit(0).cast("long").alias("below"))
        # Of a context: occurrences, distinct symbols, and occurrences of these symbols in the next shorter context.
        nodes[k] = rows.groupBy("ctx").agg(F.sum("c").alias("n"), F.count("*").alias("t"), F.sum("below").alias("x"))

    seen = counts[order].withColumn("ctx", F.shiftright("code", 8)).join(nodes[order], "ctx")
    seen = seen.select("code", F.log10((F.col("c") - 0.5) / F.col("n")).alias("value"))
    zero = F.lit(0).cast("long")
    open_ = grams.where("c = 0").select("code", F.lit(0.0).alias("value"), F.lit(False).alias("done"), zero.alias("x0"), zero.alias("t0"))
    for k in range(order, -1, -1):
        here = open_.withColumn("ck", shorter(F.col("code"), k)).withColumn("ctx", F.shiftright("ck", 8))
        here = here.join(nodes[k], "ctx", "left")
        if k < order:
            here = here.join(counts[k].select(F.col("code").alias("ck"), "c"), "ck", "left")
        else:
            here = here.withColumn("c", F.lit(None).cast("long"))
        n, t = F.col("n") - F.col("x0"), F.col("t") - F.col("t0")
        hit = ~F.col("done") & (F.col("c") > 0)
        escape = ~F.col("done") & F.col("c").isNull() & F.col("n").isNotNull() & (t > 0)
        step = F.when(hit, F.log10((F.col("c") - 0.5) / n)).when(escape, F.log10(0.5 * t / n)).otherwise(0.0)
        open_ = here.select("code", (F.col("value") + step).alias("value"), (F.col("done") | F.coalesce(hit, F.lit(False))).alias("done"), F.coalesce("x", "x0").alias("x0"), F.coalesce("t", "t0").alias("t0"))
    rest = F.when(F.col("done"), 0.0).otherwise(-F.log10(256 - F.col("t0")))
    return seen.union(open_.select("code", F.col("value") + rest))


def _scored(order: int, names: list[str], base_total: float):
    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        kind, code = right.column("kind").to_numpy(), right.column("code").to_numpy()
        value = right.column("value").to_numpy()
        tables = []
        for k in (GRAM, TOKEN):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(code[own], kind="stable")]
            tables.append((np.append(code[own], 2**63 - 1), np.append(value[own], 0.0)))
        ids, held, sizes, blob = (left.column(c).combine_chunks()[0] for c in ("ids", "held", "sizes", "blob"))
        sizes = np.array(sizes.as_py(), np.int64)
        out = {n: np.zeros(len(sizes), np.float64 if "score" in n else np.int64) for n in names[2:]}
        for a, b, data, offsets in _pieces(sizes, blob.as_py()):
            codes, of = token_hashes(data, offsets)
            at = np.searchsorted(tables[TOKEN][0], codes)
            c = np.where(tables[TOKEN][0][at] == codes, tables[TOKEN][1][at], 1.0)
            out["n_tokens"][a:b] = np.bincount(of, minlength=b - a)
            out["n_known"][a:b] = np.bincount(of, c > 0, b - a)
            out["base_score"][a:b] = np.bincount(of, np.log10((c + 0.5) / base_total), b - a)
            codes, of = gram_codes(data, offsets, order)
            out["score"][a:b] = np.bincount(of, tables[GRAM][1][np.searchsorted(tables[GRAM][0], codes)], b - a)
        return pa.Table.from_arrays([ids.values, held.values, *[pa.array(v) for v in out.values()]], names=names)

    return lambda key, left, right: score(key, left, right)


def score_corpus(df: DataFrame, id_col: str, text_col: str, held_out: Column, order: int = ORDER) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, score, train_tokens) of every row; held-out rows are not learnt from."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.coalesce(held_out, F.lit(False)).alias("held"))
    blocks = save(pack(docs), "ppm-blocks")
    asked = save(requests(blocks, order), "ppm-requests")
    # A common token has a row per block: its total is folded first and joined back, so no task holds all its rows.
    words = asked.where(F.col("kind") == TOKEN).select("code", "block", "train")
    totals = Observation()
    sums = words.groupBy("code").agg(F.sum("train").alias("c"), F.count("*").alias("blocks"))
    sums = sums.observe(totals, F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"))
    # A token that one training text holds once is not answered: no answer means a count of one.
    sums = save(sums.where("NOT (blocks = 1 AND c = 1)").select("code", F.col("c").cast("double").alias("value")), "ppm-sums")
    words = save(words.select("code", "block").join(sums, "code").select("code", "block", "value"), "ppm-tokens")
    n, v = (totals.get[x] or 0 for x in ("n", "v"))
    wanted = asked.where(F.col("kind") == GRAM).select("code", "block", "train")
    grams = save(wanted.groupBy("code").agg(F.sum("train").alias("c")), "ppm-grams")
    grams = wanted.select("code", "block").join(log_probabilities(grams, order), "code")
    answers = grams.select(F.lit(GRAM).alias("kind"), "code", "block", "value").union(words.select(F.lit(TOKEN), "code", "block", "value"))
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(order, names, n + 0.5 * (v + 1)), schema)
    return found.withColumn("train_tokens", F.lit(n).cast("long"))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 1
    found = score_corpus(docs, "doc_id", "text", held)
    return found.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
