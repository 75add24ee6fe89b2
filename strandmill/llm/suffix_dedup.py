"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier in the corpus.

1. Anchors.  In every window of LENGTH bytes the smallest hash of its K-byte strings marks an anchor; equal windows
   have equal anchors, so only suffixes at anchors need sorting, about one in thirty.  Windows of one
   anchor form a piece of text.
2. As in prefix-doubling string sorting, only suffixes that are not yet told apart are exchanged: a block keeps the first of
   its equal pieces (compared by their bytes), pieces are spread by the hash of their K bytes, those whose hash is unique drop
   out and all others go on.  Hashes decide nothing else.
3. Their suffixes are sorted block by block and exchanged as front-coded runs, cut into ranges of hash-prefixed keys.  A
   loser tree merges the runs of a range: every run keeps the common prefix with the last winner, so known
   prefixes are never compared again, and the merged order comes with its common prefix lengths.
4. Windows with offset o before their anchor are equal where the common prefix reaches LENGTH - o and the o bytes
   before are equal; all but the first of these, by (id, place), are covered.

An anchor that more than ``HOT_ROWS`` distinct pieces share (a common line before many different continuations) would
fill one range.  Its pieces are taken apart into windows, each with its own hash as key: a block sends the first of
its equal windows only, compared by their bytes, and the windows of one anchor spread over all ranges.  A piece or window has
one row per block at most, so a range holds as many rows of it as there are blocks that hold it.

Texts travel as compressed blocks.  Every byte that goes was compared with an earlier one.

Nulls: a null text is empty, a null id sorts first.  Rows with equal ids are ordered by their place in the input
blocks.  Texts under LENGTH bytes lose nothing.  Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import tokens
from strandmill.llm.ppm import pack
from strandmill.llm.scratch import save
from strandmill.llm.tokens import U

LENGTH, K = 100, 32
#: Bytes of text that a task works on at a time; arrays of eight bytes for each of them are held a dozen at once.
SLICE = 1_000_000
#: Suffixes in a range, about.
RANGE_ROWS = 60_000
#: Distinct pieces that may share an anchor's bytes before their windows are spread.
HOT_ROWS = 200_000
POS_BITS = 31
NO_ID = -(2**63)


def _blob(value: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8) if value else np.zeros(0, np.uint8)


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, hash of the anchor's bytes, hash of the piece) of the pieces of texts."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = tokens.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens._BYTE[data] * up[:n], out=sums[1:])
    grams = tokens.mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    width, places = length - k + 1, 26  # room for the place, so that the leftmost of equal hashes wins
    key = (grams >> U(places) << U(places)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full((len(key) // width + 2) * width, U(2**64 - 1))
    padded[: len(key)] = key
    ahead = np.minimum.accumulate(padded.reshape(-1, width), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    anchor = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & U((1 << places) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[:windows] == text[length - 1 :]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:windows] != text[: windows - 1]) | (inside[1:] != inside[:-1]))))
    stop = np.append(new[1:], windows)
    keep = inside[new]
    start, count = new[keep], (stop - new)[keep]
    whole = tokens.mix((sums[start + count + length - 1] - sums[start]) * down[start] ^ U(0x5851F42D4C957F2D))
    return start, count, anchor[start], grams[anchor[start]], whole


def _text_slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, end
        at = end


_PIECES = "h long, u long, id long, loc long"
_MARKS = "block long, pos long, n long, off long, h long"


def find_pieces(blocks: DataFrame, length: int, k: int) -> DataFrame:
    """(h, u, id, loc): one row per distinct piece of a block, its first; later ones of the block, equal to it byte by byte, have
    u = -1 - windows and a spread h.  u holds bits of the piece's hash, its windows and its offset of the anchor."""

    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                block = batch.column("block")[row].as_py()
                data = _blob(batch.column("blob")[row].as_py())
                sizes = np.array(batch.column("sizes")[row].as_py(), np.int64)
                ids = np.array([NO_ID if i is None else i for i in batch.column("ids")[row].as_py()], np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                found: list[list[np.ndarray]] = []
                for a, b in _text_slices(sizes):
                    start, count, anchor, h, whole = pieces(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, k)
                    of = a + np.searchsorted(offsets[a : b + 1] - offsets[a], start, "right") - 1
                    u = (whole >> U(25) << U(16) | count.astype(np.uint64) << U(8) | (anchor - start).astype(np.uint64)) & U(2**63 - 1)
                    found.append([h.view(np.int64), u.astype(np.int64), ids[of], start + offsets[a]])
                h, u, i, pos = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(4))
                order = np.lexsort((pos, i, u, h))
                h, u, i, pos = h[order], u[order], i[order], pos[order]
                again = np.zeros(len(h), bool)
                again[1:] = (h[1:] == h[:-1]) & (u[1:] == u[:-1])
                windows = u >> 8 & 255
                raw = data.tobytes()
                begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(h)))) if len(h) else pos
                same = np.flatnonzero(again)
                for piece, p, q, size in zip(same.tolist(), pos[same].tolist(), pos[begin[same]].tolist(), (windows[same] + length - 1).tolist(), strict=True):
                    if raw[p : p + size] != raw[q : q + size]:
                        again[piece] = False
                loc = pos | block << POS_BITS
                h[again] = tokens.mix(loc[again].view(np.uint64)).view(np.int64)
                u[again] = -1 - windows[again]
                for at in range(0, len(h), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 200_000]) for c in (h, u, i, loc)], names=["h", "u", "id", "loc"])

    return blocks.select("block", "ids", "sizes", "blob").mapInArrow(run, _PIECES)


def tell_apart(found: DataFrame) -> DataFrame:
    """(block, pos, n, off, h): pieces equal to an earlier one of their block (off = -1), and pieces that may share their anchor's bytes.

    Rows come sorted by h; what is kept from one batch to the next is the last row.
    """

    def run(batches):
        last = None  # the previous row: h, loc, u, and whether it has been passed on
        for batch in batches:
            h, u, loc = (batch.column(c).to_numpy() for c in ("h", "u", "loc"))
            local = u < 0
            out = [(loc[local], -1 - u[local], np.full(int(local.sum()), -1), h[local])]
            h, u, loc = h[~local], u[~local], loc[~local]
            if len(h):
                same = np.concatenate(([last is not None and h[0] == last[0]], h[1:] == h[:-1]))
                if same[0] and not last[3]:
                    out.append(tuple(np.array([x]) for x in (last[1], last[2] >> 8 & 255, last[2] & 255, last[0])))
                shared = same | np.append(same[1:], False)
                out.append((loc[shared], u[shared] >> 8 & 255, u[shared] & 255, h[shared]))
                last = (h[-1], loc[-1], u[-1], bool(shared[-1]))
            loc_, n_, off, h_ = (np.concatenate([o[c] for o in out]).astype(np.int64) for c in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (loc_ >> POS_BITS, loc_ & ((1 << POS_BITS) - 1), n_, off, h_)], names=["block", "pos", "n", "off", "h"])

    return found.repartition("h").sortWithinPartitions("h", "loc").mapInArrow(run, _MARKS)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(common prefix with the string before, tail length, tails) of sorted strings of up to 255 bytes."""
    shared, lengths, tails, before = bytearray(), bytearray(), [], b""
    for s in strings:
        c = common(before, s, 0)
        shared.append(c)
        lengths.append(len(s) - c)
        tails.append(s[c:])
        before = s
    return bytes(shared), bytes(lengths), b"".join(tails)


def unfold(shared: bytes, lengths: bytes, tails: bytes) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the string before, string) of a front-coded run."""
    at, before = 0, b""
    for c, n in zip(shared, lengths, strict=True):
        before = before[:c] + tails[at : at + n]
        at += n
        yield c, before


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int]]:
    """(run, common prefix with the winner before) in merged order, by a loser tree over common prefixes.

    A player is (common prefix with the last winner, string).  Of two players with different prefixes the
    longer is smaller and the loser's prefix stays right; only with equal prefixes are bytes compared, from there on.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    heads: list[tuple[int, bytes] | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    prefix = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's prefix to the one with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        c = common(x[1], y[1], prefix[a])
        less = x[1][c : c + 1] < y[1][c : c + 1] or (x[1][c : c + 1] == y[1][c : c + 1] and a < b)
        winner, loser = (a, b) if less else (b, a)
        prefix[loser] = c
        return winner, loser

    losers = [0] * size
    level = list(range(size))
    at = size
    while at > 1:
        at //= 2
        pairs = [play(level[2 * k], level[2 * k + 1]) for k in range(at)]
        losers[at : 2 * at] = [p[1] for p in pairs]
        level = [p[0] for p in pairs]
    winner = level[0]
    while heads[winner] is not None:
        yield winner, prefix[winner]
        heads[winner] = next(runs[winner], None)
        prefix[winner] = heads[winner][0] if heads[winner] else 0
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


_RUNS = "range long, shared binary, lengths binary, tails binary, left_lengths binary, lefts binary, meta binary, known binary"


def spread_windows(raw: bytes, pos: np.ndarray, n: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes) of the first windows, by (id, place), of the pieces of one block, and the starts of those equal to an earlier one."""
    starts = np.repeat(pos - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    starts = starts[np.lexsort((starts, np.repeat(ids, n)))]
    seen: set[bytes] = set()
    again = np.zeros(len(starts), bool)
    hashes = np.zeros(len(starts), np.uint64)
    for k, at in enumerate(starts.tolist()):
        window = raw[at : at + length]
        if window in seen:
            again[k] = True
        else:
            seen.add(window)
            hashes[k] = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "big")
    return starts[~again], hashes[~again], starts[again]


def sorted_runs(blocks: DataFrame, marks: DataFrame, ranges: int, length: int, hot: DataFrame | None = None) -> DataFrame:
    """Front-coded sorted runs, one per block and range: the keys are hash + bytes from the anchor on.

    ``hot`` (h): anchors whose windows are spread; what a block knows of them itself goes along as ``known`` (block, place, windows).
    """
    wanted = marks.where("off >= 0")
    wanted = wanted.join(hot.select("h", F.lit(True).alias("hot")), "h", "left") if hot is not None else wanted.withColumn("hot", F.lit(None).cast("boolean"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in _RUNS.split(", ")}
        if len(right) and len(left):
            data = _blob(left.column("blob")[0].as_py())
            sizes, ids = np.array(left.column("sizes")[0].as_py(), np.int64), left.column("ids")[0].as_py()
            ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
            block = left.column("block")[0].as_py()
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            raw = data.tobytes()
            pos, n, off, h = (right.column(c).to_numpy() for c in ("pos", "n", "off", "h"))
            h = tokens.mix(h.view(np.uint64))  # anchors have small hashes; mixed ones fill all ranges alike
            known = np.zeros(0, np.int64)
            is_hot = right.column("hot").is_valid().to_numpy()
            if is_hot.any():
                of = np.searchsorted(offsets, pos[is_hot], "right") - 1
                starts, hashes, known = spread_windows(raw, pos[is_hot], n[is_hot], ids[of], length)
                ones, zeros = np.ones(len(starts), np.int64), np.zeros(len(starts), np.int64)
                pos, n, off, h = (np.concatenate((old[~is_hot], new)) for old, new in ((pos, starts), (n, ones), (off, zeros), (h, hashes)))
            of = np.searchsorted(offsets, pos, "right") - 1
            end = np.minimum(pos + n - 1 + length, offsets[of + 1])
            keys = [hh.to_bytes(8, "big") + raw[p + o : e] for hh, p, o, e in zip(h.tolist(), pos.tolist(), off.tolist(), end.tolist(), strict=True)]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            part = ((h[order] >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
            for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate((np.flatnonzero(np.diff(part, prepend=-1)), [len(part)])).tolist()), strict=True):
                chosen = order[a:b]
                shared, lengths, tails = front_code([keys[k] for k in chosen])
                meta = np.array([[ids[of[k]], pos[k] + off[k], n[k], block] for k in chosen], np.int64)
                lefts = [raw[pos[k] : pos[k] + off[k]] for k in chosen]
                for name, value in (("range", int(part[a])), ("shared", shared), ("lengths", lengths), ("tails", tails), ("left_lengths", bytes(map(len, lefts))), ("lefts", b"".join(lefts)), ("meta", meta.tobytes()), ("known", b"")):
                    out[name].append(value)
            if len(known):
                known = np.sort(known)
                first = np.flatnonzero(np.diff(known, prepend=-2) != 1)
                marked = np.stack((np.full(len(first), block), known[first], np.diff(np.append(first, len(known)))), axis=1).astype(np.int64)
                for name in out:
                    out[name].append(block % ranges if name == "range" else marked.tobytes() if name == "known" else b"")
        return pa.Table.from_arrays([pa.array(v, pa.int64() if c == "range" else pa.binary()) for c, v in out.items()], names=list(out))

    return blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, _RUNS)


def repeated_windows(prefixes: np.ndarray, meta: np.ndarray, lefts: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """covered[item, o] for items in merged order: whether the window o bytes before the anchor starts earlier elsewhere.

    ``prefixes``: common prefix of each item's bytes from the anchor with the item before; ``meta``: id, anchor, windows, block;
    ``lefts[item, o]``: the byte o + 1 before the anchor.
    """
    deepest = lefts.shape[1]
    covered = np.zeros((len(meta), deepest + 1), bool)
    least = off - (meta[:, 2] - 1)
    seen = np.zeros(len(meta), np.uint64)
    place = meta[:, 3] << POS_BITS | meta[:, 1]
    for o in range(deepest + 1):
        if o:
            seen = tokens.mix(seen * U(31) + lefts[:, o - 1] + U(1))
        run = np.cumsum(prefixes < length - o)
        at = np.flatnonzero((least <= o) & (o <= off))
        at = at[np.bincount(run[at])[run[at]] > 1] if len(at) else at
        if len(at):
            at = at[np.lexsort((place[at], meta[at, 0], seen[at], run[at]))]
            covered[at[1:], o] = (run[at][1:] == run[at][:-1]) & (seen[at][1:] == seen[at][:-1])
    return covered


def merge_ranges(runs: DataFrame, length: int, k: int) -> DataFrame:
    """(block, pos, n): windows of the exchanged suffixes that start earlier elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        known = np.concatenate([np.frombuffer(r["known"], np.int64).reshape(-1, 3) for r in rows])
        rows = [r for r in rows if r["shared"]]
        if not rows:
            return pa.Table.from_arrays([pa.array(known[:, c]) for c in range(3)], names=["block", "pos", "n"])
        order = list(merge([unfold(r["shared"], r["lengths"], r["tails"]) for r in rows]))
        starts = np.concatenate(([0], np.cumsum([len(r["shared"]) for r in rows])))
        nth = [0] * len(rows)
        items = np.zeros(len(order), np.int64)
        for j, (r, _) in enumerate(order):
            items[j] = starts[r] + nth[r]
            nth[r] += 1
        prefixes = np.array([c for _, c in order], np.int64) - 8  # the hash before the bytes
        meta = np.concatenate([np.frombuffer(r["meta"], np.int64).reshape(-1, 4) for r in rows])[items]
        off_all = np.concatenate([np.frombuffer(r["left_lengths"], np.uint8) for r in rows]).astype(np.int64)
        flat = np.frombuffer(b"".join(r["lefts"] for r in rows) + b"\0", np.uint8)
        ends = np.cumsum(off_all)[items]
        off = off_all[items]
        back = np.arange(length - k)
        lefts = np.where(back[None, :] < off[:, None], flat[np.maximum(ends[:, None] - 1 - back[None, :], 0)], 0)
        covered = repeated_windows(prefixes, meta, lefts, off, length)
        # Windows o + m .. o of an item are neighbours in the text; each maximal run becomes one mark.
        edge = np.diff(np.pad(covered.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        item, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        pos = meta[item, 1] - (high - 1)
        found = np.concatenate((np.stack((meta[item, 3], pos, high - low), axis=1), known))
        return pa.Table.from_arrays([pa.array(found[:, c]) for c in range(3)], names=["block", "pos", "n"])

    return runs.groupBy("range").applyInArrow(run, "block long, pos long, n long")


def cut(blocks: DataFrame, marks: DataFrame, id_kind: str, length: int, with_text: bool) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs, SHA-256 of the rest, and the rest itself if wanted."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        data = _blob(left.column("blob")[0].as_py())
        sizes = np.array(left.column("sizes")[0].as_py(), np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        pos, n = (right.column(c).to_numpy() for c in ("pos", "n"))
        order = np.argsort(pos, kind="stable")
        pos, n = pos[order], n[order]
        removed, spans, digests, kept = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [], []
        for a, b in _text_slices(sizes):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            own = slice(*np.searchsorted(pos, [offsets[a], offsets[b]]))
            edge = np.zeros(len(part) + 1, np.int32)
            np.add.at(edge, pos[own] - offsets[a], 1)
            np.add.at(edge, pos[own] + n[own] + length - 1 - offsets[a], -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            first = at[:-1][sizes[a:b] > 0]
            begin[first] = gone[first]
            before, runs = (np.concatenate(([0], np.cumsum(x, dtype=np.int32)))[at] for x in (gone, begin))
            removed[a:b], spans[a:b] = np.diff(before), np.diff(runs)
            rest, rest_at = part[~gone].tobytes(), (at - before).tolist()
            for x, y in zip(rest_at[:-1], rest_at[1:], strict=True):
                digests.append(hashlib.sha256(rest[x:y]).hexdigest())
                kept.append(rest[x:y] if with_text else None)
        cols = [left.column("ids").combine_chunks()[0].values, pa.array(sizes), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())]
        return pa.Table.from_arrays([*cols, pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = f"id {id_kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return blocks.groupBy("block").cogroup(marks.select("block", "pos", "n").groupBy("block")).applyInArrow(run, schema)


def remove_repeats(df: DataFrame, id_col: str, text_col: str, length: int = LENGTH, k: int = K, with_text: bool = True, range_rows: int = RANGE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of ``df``; ids are whole numbers."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.lit(False).alias("held"))
    blocks = save(pack(docs).drop("held"), "suffix-blocks")
    marks = save(tell_apart(find_pieces(blocks, length, k)), "suffix-marks")
    shared = marks.where("off >= 0").groupBy("h").agg(F.count("*").alias("pieces"), F.sum("n").alias("windows"))
    is_hot = F.col("pieces") > hot_rows
    rows, spread = shared.agg(F.sum(F.when(is_hot, F.col("windows")).otherwise(F.col("pieces"))), F.count_if(is_hot)).first()
    hot = save(shared.where(is_hot).select("h"), "suffix-hot") if spread else None
    ranges = max(1, -(-(rows or 0) // range_rows))
    repeats = merge_ranges(sorted_runs(blocks, marks, ranges, length, hot), length, k)
    covered = marks.where("off < 0").select("block", "pos", "n").union(repeats)
    return cut(blocks, covered, "long", length, with_text)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, "doc_id", "text", with_text=False).withColumnRenamed("id", "doc_id").drop("kept")
