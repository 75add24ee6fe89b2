"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

Legal are role initials of the form ``(s?(ua)+)?``.  A row is kept (K, 0), gets the role user or assistant (R, 2) or is
deleted (D, 3; the only way for blank and duplicate rows); empty user and assistant rows are inserted (I, 2) anywhere; each
truncated row that stays adds 1.  Of the cheapest edits those with the ASCII-least string of initials win.

Rank-compressed dynamic programme.  A layer is a row.  A macro edit is a run of inserts with the row's own edit; as every macro
ends in D, K or R, macros are prefix-free codes, and so are the strings of one layer.  A string is therefore known by its rank
among the states of its layer, the rank of a longer one by (rank of its parent, place of its code), and no string is built
before the end: a layer keeps costs, ranks and pointers to parents; the edits are read back from the pointers.  The layers
of many conversations are computed at once.

A conversation of more than ``ROWS`` rows or ``BYTES`` bytes is cut into ranges of turns.  The same programme, from each of
the four states, gives a range sixteen costs and ranks; ranges are chained like rows, and each then reads back its
own edits.  So no task holds such a conversation; only its summaries, one per range, meet in one.  Rows of one conversation
and turn stay together.

Nulls: a null role or text is one space, null turns come first, null ids form one conversation.  Rows of a turn are ordered by role
and text, so results do not depend on the order of the input.  A row with ``times`` = 0 only names its conversation.
Empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.scratch import save

#: Rows and bytes of a conversation above which it is cut into ranges, and about the rows and bytes of a range.
ROWS, BYTES = 4096, 8 << 20
RANGE_ROWS, RANGE_BYTES = 100_000, 32 << 20
#: Ids below which the set of long conversations is broadcast; above, it is joined.
BROADCAST_IDS = 100_000
SPACE = " \t\n\x0b\x0c\r"
INITIALS = {"s": 1, "u": 2, "a": 3}
FAR = 1 << 40  # cost of a state that cannot be reached

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_INSERT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
_KEEP = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}
#: What is inserted at the end, by state.
_CLOSING = {0: [], 1: ["user", "assistant"], 2: ["assistant"], 3: []}


def _macros() -> list[dict]:
    """Every useful (state before, inserts, edit): a second insert that leads back to the same state is none."""
    found = []
    for p in range(4):
        at, roles = p, []
        for _ in range(3 if p < 2 else 2):
            code = "I" * len(roles)
            found.append({"p": p, "code": code + "D", "q": at, "cost": 2 * len(roles) + 3, "roles": roles, "role": None, "initials": (0, 1, 2, 3)})
            to, role = _INSERT[at]
            found.append({"p": p, "code": code + "R", "q": to, "cost": 2 * len(roles) + 2, "roles": roles, "role": role, "initials": (0, 1, 2, 3)})
            for (state, initial), q in _KEEP.items():
                if state == at:
                    found.append({"p": p, "code": code + "K", "q": q, "cost": 2 * len(roles), "roles": roles, "role": None, "initials": (initial,)})
            at, roles = to, [*roles, role]
    return found


MACROS = _macros()
_codes = sorted({m["code"] for m in MACROS})
_P = np.array([m["p"] for m in MACROS])
_CODE = np.array([_codes.index(m["code"]) for m in MACROS])
_COST = np.array([m["cost"] for m in MACROS])
_STAYS = np.array([not m["code"].endswith("D") for m in MACROS])
_INTO = [np.array([k for k, m in enumerate(MACROS) if m["q"] == q]) for q in range(4)]
#: What a macro costs a row: allowed[initial, must be deleted, macro].
_ALLOWED = np.array([[[i in m["initials"] and not (must and m["code"][-1] != "D") for m in MACROS] for must in (False, True)] for i in range(4)])


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Number of smaller keys in each row of ``keys``; equal strings, which only different entries have, rank alike."""
    return (keys[:, :, None] > keys[:, None, :]).sum(2)


class Layers:
    """The programme over many sequences of rows; ``entries`` are the states that each of them is entered in."""

    def __init__(self, lengths: np.ndarray, initial: np.ndarray, must: np.ndarray, cut: np.ndarray, entries: tuple[int, ...]):
        self.order = np.argsort(-lengths, kind="stable")
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        self.lengths = lengths[self.order]
        n, e = len(lengths), len(entries)
        self.cost = np.full((n, e, 4), FAR, np.int64)
        self.cost[:, np.arange(e), list(entries)] = 0
        self.rank = np.zeros((n, e, 4), np.int64)
        self.pointers: list[np.ndarray] = []
        for layer in range(int(self.lengths[0]) if n else 0):
            live = int(np.searchsorted(-self.lengths, -layer, "left"))
            row = self.starts[:live] + layer
            step = np.where(_ALLOWED[initial[row], must[row].astype(int)], _COST + _STAYS * cut[row][:, None], FAR)
            total = np.minimum(self.cost[:live][:, :, _P] + step[:, None, :], FAR)
            key = total << 8 | self.rank[:live][:, :, _P] << 4 | _CODE
            pointer = np.zeros((live, e, 4), np.int8)
            best = np.zeros((live, e, 4), np.int64)
            for q, into in enumerate(_INTO):
                at = key[:, :, into].argmin(2)
                pointer[:, :, q] = into[at]
                best[:, :, q] = np.take_along_axis(key[:, :, into], at[:, :, None], 2)[:, :, 0]
            self.cost[:live] = best >> 8
            flat = np.where(best >> 8 >= FAR, 255, best & 255).reshape(live, -1)
            self.rank[:live] = np.minimum(_ranks(flat), 15).reshape(live, e, 4)
            self.pointers.append(pointer)

    def back(self, entry: np.ndarray, state: np.ndarray, n_rows: int) -> np.ndarray:
        """The macro of every row, from ``entry`` (index) to ``state`` of each sequence, both in the given order."""
        entry, state = entry[self.order], state[self.order].copy()
        out = np.zeros(n_rows, np.int8)
        for layer in range(len(self.pointers) - 1, -1, -1):
            live = len(self.pointers[layer])
            macro = self.pointers[layer][np.arange(live), entry[:live], state[:live]]
            out[self.starts[:live] + layer] = macro
            state[:live] = _P[macro]
        return out


def closing(cost: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state, cost) in which sequences with these costs and ranks [sequence, state] end best."""
    key = (cost + np.array([2 * len(_CLOSING[q]) for q in range(4)])) << 4 | rank
    state = key.argmin(1)
    return state, np.take_along_axis(key, state[:, None], 1)[:, 0] >> 4


class Rows:
    """The rows of whole sequences, in order: faults and what the programme needs of them."""

    def __init__(self, table: pa.Table, sequence: np.ndarray, n: int):
        times = table.column("times").to_numpy()
        each = np.repeat(np.arange(len(times)), times)
        roles, texts = table.column("role").to_pylist(), table.column("text").to_pylist()
        earlier = table.column("earlier").to_pylist() if "earlier" in table.column_names else [False] * len(times)
        self.role, self.text = [roles[k] for k in each.tolist()], [texts[k] for k in each.tolist()]
        self.of = sequence[each]
        self.lengths = np.bincount(self.of, minlength=n)
        fault, seen, last = np.zeros(len(each), np.int8), set(), -1
        for k, (s, role, text, row) in enumerate(zip(self.of.tolist(), self.role, self.text, each.tolist(), strict=True)):
            if s != last:
                seen, last = set(), s
            end = text.rstrip(SPACE)[-1:]
            fault[k] = 1 if not end else 2 if earlier[row] or (role, text) in seen else 3 if end not in ".!?" else 0
            seen.add((role, text))
        self.initial = np.array([INITIALS.get(r[:1], 0) for r in self.role], np.int64)
        self.must, self.cut = (fault == 1) | (fault == 2), (fault == 3).astype(np.int64)
        pair = self.initial[:-1] * 4 + self.initial[1:]
        wrong = (self.of[1:] == self.of[:-1]) & ~np.isin(pair, (1 * 4 + 2, 2 * 4 + 3, 3 * 4 + 2))
        count = lambda of: np.bincount(of, minlength=n)
        self.stats = {name: count(self.of[fault == k]) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))}
        self.stats["illegal"] = count(self.of[1:][wrong])
        turns = table.column("turn").combine_chunks().take(pa.array(each))
        known = turns.is_valid().to_numpy(zero_copy_only=False)
        turn, of = turns.fill_null(0).to_numpy(zero_copy_only=False), self.of
        new = known.copy()
        new[1:] &= (of[1:] != of[:-1]) | (turn[1:] != turn[:-1]) | ~known[:-1]
        some = np.flatnonzero(count(of[known]) > 0)
        self.turn_least, self.turn_most, self.turns = np.zeros(n, np.int64), np.zeros(n, np.int64), count(of[new])
        if len(some):
            starts = np.searchsorted(of[known], some)
            ends = np.append(starts[1:], known.sum()) - 1
            self.turn_least[some], self.turn_most[some] = turn[known][starts], turn[known][ends]
        self.has_turn = self.turns > 0

    def edits(self, macros: np.ndarray, closing: list[list[str]]) -> tuple[pa.Array, pa.Array]:
        """(audit, messages) of every sequence."""
        audit, roles, texts, offsets = [], [], [], [0]
        at = 0
        for n, end in zip(self.lengths.tolist(), closing, strict=True):
            codes = []
            for k in range(at, at + n):
                m = MACROS[macros[k]]
                codes.append(m["code"])
                roles += m["roles"]
                texts += [""] * len(m["roles"])
                if m["code"][-1] != "D":
                    roles.append(m["role"] or self.role[k])
                    texts.append(self.text[k])
            at += n
            roles += end
            texts += [""] * len(end)
            audit.append("".join(codes) + "I" * len(end))
            offsets.append(len(roles))
        rows = pa.StructArray.from_arrays([pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=["role", "text"])
        return pa.array(audit, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_MESSAGES = "array<struct<role:string,text:string>>"


def _whole(table: pa.Table, sequence: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    rows = Rows(table, sequence, len(first))
    layers = Layers(rows.lengths, rows.initial, rows.must, rows.cut, (0,))
    given = np.argsort(layers.order)
    state, cost = closing(layers.cost[given, 0], layers.rank[given, 0])
    audit, messages = rows.edits(layers.back(np.zeros(len(first), int), state, len(rows.of)), [_CLOSING[q] for q in state.tolist()])
    gaps = np.where(rows.has_turn, rows.turn_most - rows.turn_least + 1 - rows.turns, 0)
    stats = [gaps, *(rows.stats[c] for c in STATS[1:5]), cost]
    ones = pa.array(np.zeros(len(first), np.int64))
    ids = table.column("conv").combine_chunks().take(pa.array(first))
    return pa.RecordBatch.from_arrays([ids, ones, pa.array(np.ones(len(first), np.int64)), *[pa.array(s.astype(np.int64)) for s in stats], audit, messages], names=["conv", "range", "ranges", *STATS, "audit", "messages"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, number of each row's conversation, first row of each) of whole conversations; rows of one stand together."""
    held: list[pa.RecordBatch] = []

    def numbered(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        ids = table.column("conv").to_pylist()
        new = np.array([k == 0 or ids[k] != ids[k - 1] for k in range(len(ids))], bool)
        return table, np.cumsum(new) - 1, np.flatnonzero(new)

    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column("conv").to_pylist()
        last = len(ids) - 1
        while last and ids[last] == ids[last - 1]:
            last -= 1
        if last or held and ids[0] != held[-1].column("conv")[-1].as_py():
            yield numbered([*held, batch.slice(0, last)] if last else held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield numbered(held)


def _repair_whole(rows: DataFrame, kind: str) -> DataFrame:
    schema = f"conv {kind}, range long, ranges long, {', '.join(f'{c} long' for c in STATS)}, audit string, messages {_MESSAGES}"

    def run(batches):
        for table, sequence, first in _sequences(batches):
            yield _whole(table, sequence, first)

    return rows.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text").mapInArrow(run, schema)


def _ordered(table: pa.Table) -> pa.Table:
    """Rows by turn, nulls first, then role and text as Spark orders them, by UTF-8 bytes."""
    turn, role, text = (table.column(c).to_pylist() for c in ("turn", "role", "text"))
    order = sorted(range(len(turn)), key=lambda k: (turn[k] is not None, turn[k] or 0, role[k].encode(), text[k].encode()))
    return table.take(pa.array(order, pa.int64()))


_SUMMARY = "cost array<long>, rank array<long>, first int, last int, rows long, least long, most long, turns long, " + ", ".join(f"{c} long" for c in STATS[1:5])


def _summarise(placed: DataFrame, kind: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows = Rows(_ordered(table), np.zeros(len(table), int), 1)
        layers = Layers(rows.lengths, rows.initial, rows.must, rows.cut, (0, 1, 2, 3))
        n = len(rows.of)
        ends = [int(rows.initial[0]), int(rows.initial[-1])] if n else [-1, -1]
        turns = [int(rows.turn_least[0]), int(rows.turn_most[0])] if rows.has_turn[0] else [None, None]
        value = [table.column("conv")[0].as_py(), table.column("range")[0].as_py(), layers.cost[0].ravel().tolist(), layers.rank[0].ravel().tolist(), *ends, n, *turns, int(rows.turns[0]), *(int(rows.stats[c][0]) for c in STATS[1:5])]
        names = ["conv", "range", *[c.split()[0] for c in _SUMMARY.split(", ")]]
        kinds = [table.schema.field("conv").type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), *[pa.int64()] * 8]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(value, kinds, strict=True)], names=names)

    return placed.groupBy("conv", "range").applyInArrow(run, f"conv {kind}, range long, {_SUMMARY}")


def chain(costs: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(state at the entry of each range, state at its end, cost) of the best way through ranges [range, from, to]."""
    cost, rank, parents = np.array([0, FAR, FAR, FAR]), np.zeros(4, np.int64), []
    for c, r in zip(costs, ranks, strict=True):
        key = np.minimum(cost[:, None] + c, FAR) << 8 | rank[:, None] << 4 | r
        parents.append(key.argmin(0))
        best = key.min(0)
        cost = best >> 8
        rank = np.minimum(_ranks(np.where(cost >= FAR, 255, best & 255)[None])[0], 15)
    state, total = closing(cost[None], rank[None])
    at, ends = int(state[0]), []
    for parent in reversed(parents):
        ends.append(at)
        at = int(parent[at])
    ends = np.array(ends[::-1])
    return np.concatenate(([0], ends[:-1])), ends, int(total[0])


def _chain(summaries: DataFrame, kind: str) -> DataFrame:
    """(conv, range, ranges, entry, state, is_last, stats of the conversation) for every range."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("range").to_pydict()
        n = len(t["range"])
        entry, state, cost = chain(np.array(t["cost"]).reshape(n, 4, 4), np.array(t["rank"]).reshape(n, 4, 4))
        full = [k for k in range(n) if t["rows"][k]]
        between = sum((t["last"][a], t["first"][b]) not in ((1, 2), (2, 3), (3, 2)) for a, b in zip(full[:-1], full[1:], strict=True))
        least, most = [x for x in t["least"] if x is not None], [x for x in t["most"] if x is not None]
        gaps = max(most) - min(least) + 1 - sum(t["turns"]) if least else 0
        stats = {"gaps": gaps, **{c: sum(t[c]) for c in STATS[1:5]}, "cost": cost}
        stats["illegal"] += between
        cols = [pa.array(t["conv"], table.schema.field("conv").type), pa.array(t["range"], pa.int64()), pa.array([n] * n, pa.int64()), pa.array(entry, pa.int32()), pa.array(state, pa.int32()), pa.array([k == n - 1 for k in range(n)])]
        return pa.Table.from_arrays([*cols, *[pa.array([stats[c]] * n, pa.int64()) for c in STATS]], names=["conv", "range", "ranges", "entry", "state", "is_last", *STATS])

    schema = f"conv {kind}, range long, ranges long, entry int, state int, is_last boolean, {', '.join(f'{c} long' for c in STATS)}"
    return summaries.groupBy("conv").applyInArrow(run, schema)


def _repair_ranges(rows: DataFrame, kind: str, n_ranges: int) -> DataFrame:
    placed = save(rows.repartitionByRange(n_ranges, "conv", "turn").withColumn("range", F.spark_partition_id().cast("long")), "conversation-ranges")
    mark = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    marked = placed.where("times > 0").groupBy("conv", mark.alias("mark")).agg(F.min("range").alias("low"), F.max("range").alias("high")).where("low < high")
    marked = marked.select(F.col("conv").alias("__conv"), "mark", "low")
    again = (F.col("__conv").eqNullSafe(F.col("conv"))) & (F.col("mark") == mark)
    flagged = placed.join(marked, again, "left").select(*placed.columns, F.coalesce(F.col("low") < F.col("range"), F.lit(False)).alias("earlier"))
    flagged = save(flagged, "conversation-rows")
    chosen = save(_chain(_summarise(flagged, kind), kind), "conversation-chain")
    named = chosen.withColumnsRenamed({"conv": "__conv", "range": "__range"})
    rows = flagged.join(named, F.col("__conv").eqNullSafe(F.col("conv")) & (F.col("__range") == F.col("range"))).drop("__conv", "__range")

    def run(table: pa.Table) -> pa.Table:
        rows = Rows(_ordered(table), np.zeros(len(table), int), 1)
        layers = Layers(rows.lengths, rows.initial, rows.must, rows.cut, (0, 1, 2, 3))
        entry, state, last = (table.column(c)[0].as_py() for c in ("entry", "state", "is_last"))
        macros = layers.back(np.array([entry]), np.array([state]), len(rows.of))
        audit, messages = rows.edits(macros, [_CLOSING[state] if last else []])
        return pa.Table.from_arrays([*[table.column(c).combine_chunks().slice(0, 1) for c in ("conv", "range", "ranges", *STATS)], audit, messages], names=["conv", "range", "ranges", *STATS, "audit", "messages"])

    schema = f"conv {kind}, range long, ranges long, {', '.join(f'{c} long' for c in STATS)}, audit string, messages {_MESSAGES}"
    return rows.groupBy("conv", "range").applyInArrow(run, schema)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: str | None = None, rows: int = ROWS, size: int = BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The repaired conversations of ``df``: (conv, range, ranges, gaps, blank, duplicate, truncated, illegal, cost, audit, messages).

    A conversation has one row (ranges = 1), or one for each range of its turns, in order; counts are those of the whole
    conversation.  ``messages`` holds the repaired (role, text).  ``times`` names a column with how often a row stands there.
    """
    kind = df.schema[conv].dataType.simpleString()
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    often = F.col(times).cast("long") if times else F.lit(1).cast("long")
    plain = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), often.alias("times"))
    weight = plain.groupBy("conv").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.octet_length("text")).alias("b"))
    long_ = save(weight.where((F.col("n") > rows) | (F.col("b") > size)), "conversation-long")
    found, n, b = long_.agg(F.count("*"), F.sum("n"), F.sum("b")).first()
    if not found:
        return _repair_whole(plain, kind)
    ids = long_.select(F.col("conv").alias("__conv"))
    ids = F.broadcast(ids) if found <= BROADCAST_IDS else ids
    same = F.col("conv").eqNullSafe(F.col("__conv"))
    ranges = max(1, -(-n // range_rows), -(-b // RANGE_BYTES))
    short = _repair_whole(plain.join(ids, same, "left_anti"), kind)
    return short.union(_repair_ranges(plain.join(ids, same, "left_semi"), kind, ranges))


def damage(df: DataFrame) -> DataFrame:
    """``conversations`` with seeded faults: conv_id, turn, role, text and ``times`` (0 where the row is dropped, 2 where it is repeated)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.pmod(F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")), F.lit(20))
    times = F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).cast("long")
    text = F.when(draw == 1, "").when(draw == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(draw == 4, "user").otherwise(space("role"))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, stats, audit, repaired_sha256): one row per conversation.  The ranges of a long one pass through one task in order, one at
    a time; SHA-256 has to be read in order."""
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    one = repaired.where("ranges = 1").select("conv", *STATS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    names = ["conv", *STATS, "audit", "repaired_sha256"]

    def run(batches):
        held, audit, digest, begun = None, [], None, False

        def emit():
            return pa.RecordBatch.from_arrays([*[held.column(c) for c in ("conv", *STATS)], pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=names)

        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                if held is None or row.column("conv")[0].as_py() != held.column("conv")[0].as_py():
                    if held is not None:
                        yield emit()
                    held, audit, digest, begun = row.select(["conv", *STATS]), [], hashlib.sha256(), False
                audit.append(row.column("audit")[0].as_py())
                if row.column("some")[0].as_py():
                    digest.update(("\n" if begun else "").encode() + row.column("lines")[0].as_buffer().to_pybytes())
                    begun = True
        if held is not None:
            yield emit()

    several = repaired.where("ranges > 1").select("conv", "range", *STATS, "audit", lines.alias("lines"), (F.size("messages") > 0).alias("some"))
    return one.union(several.repartition("conv").sortWithinPartitions("conv", "range").mapInArrow(run, one.schema))


def op13(spark, sf_dir: str) -> DataFrame:
    rows = damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return digests(repair(rows, times="times")).withColumnRenamed("conv", "conv_id")


_VALUES = ", ".join(f"({m['p']}, '{m['code']}', {m['q']}, {m['cost']}, {['NULL', repr(m['role'])][m['role'] is not None]}, {m['roles']!r}::VARCHAR[], {list(m['initials'])})" for m in MACROS)
_ENDS = ", ".join(f"({q}, {roles!r}::VARCHAR[])" for q, roles in _CLOSING.items())

#: The same rows layer by layer with whole strings, for small tables.
OP13_SQL = rf"""
WITH RECURSIVE
crcs AS (SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(0, 256) r(i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda c: ascii(c)::BIGINT) AS bytes
  FROM conversations
),
drawn AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS d
  FROM keyed, crcs
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    list_position(['s', 'u', 'a'], left(role, 1)) AS initial,
    concat(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i), left(role, 1)) AS pair
  FROM numbered
),
macros(p, code, q, cost, new_role, inserted, initials) AS (VALUES {_VALUES}),
ends(q, inserted) AS (VALUES {_ENDS}),
layers AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM conversations
  UNION ALL
  SELECT l.conv_id, l.i + 1, m.q, min({{
    'cost': l.best.cost + m.cost + CASE WHEN f.fault = 'truncated' AND m.code NOT LIKE '%D' THEN 1 ELSE 0 END,
    'audit': l.best.audit || m.code,
    'lines': l.best.lines || list_transform(m.inserted, lambda r: r || ':') || CASE WHEN m.code LIKE '%D' THEN [] ELSE [concat(coalesce(m.new_role, f.role), ':', f.text)] END}})
  FROM layers l JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i + 1
  JOIN macros m ON m.p = l.q AND list_contains(m.initials, coalesce(f.initial, 0)) AND (f.fault NOT IN ('blank', 'duplicate') OR m.code LIKE '%D')
  GROUP BY l.conv_id, l.i, m.q
),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
),
closed AS (
  SELECT l.conv_id, min({{'cost': l.best.cost + 2 * len(e.inserted), 'audit': l.best.audit || repeat('I', len(e.inserted)), 'lines': l.best.lines || list_transform(e.inserted, lambda r: r || ':')}}) AS best
  FROM layers l JOIN ends e ON e.q = l.q LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM l.conv_id
  WHERE l.i = coalesce(c.n, 0) GROUP BY l.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM closed e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
