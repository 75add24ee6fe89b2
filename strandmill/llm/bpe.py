"""Byte-level BPE: texts to token ids and back, by batched numpy merge rounds.

The distinct words of a few megabytes of text lie as symbols in one flat array.  A round looks up all neighbouring pairs by
binary search in the sorted pair keys, takes the lowest rank of each word, and merges that pair wherever it stands
in the word, from the left; words without a mergeable pair leave the array.  Most words need fewer rounds than
they have bytes, and a round costs a few passes over what is left.  What is open after ``ROUNDS`` rounds (words of thousands of
letters) goes on in rank order: a round then merges one rank in all words and touches the places that have it alone.

A vocabulary is the JSON file of a byte-level BPE of the tokenizers library, named by a path that the driver reads; its
tables (a few MB, bounded by the file) are broadcast.  Special tokens in a text are found first, leftmost and, of those that start
there, longest.  Ids without a token in the vocabulary decode to nothing, bytes that are no UTF-8 to U+FFFD.

Nulls: a null text has no tokens, null ids decode to the empty text.  Repeated rows are encoded each for itself, a
word once per slice of text.  Words of a long text are taken in blocks, so a text needs memory for its tokens only.
Empty tables give an empty result; further columns pass through, and a column with the name of the result is replaced.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import tokens

#: How the pre-tokenizer of byte-level vocabularies cuts words (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that a task encodes at once, and words of a text that are looked up at once.
SLICE, WORDS = 1_000_000, 400_000
#: Characters of a text above which its words come in blocks.
LONG = 1_000_000
#: Distinct words that a task remembers, the first ones that it meets; others are merged again in each block that has them.
KNOWN = 120_000
#: Rows that are decoded at once.
DECODED = 256
#: Rounds over all open words before rank order takes over.
ROUNDS = 48
NONE = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next free one from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tables of one vocabulary: sorted pair keys, what each pair merges to and when, bytes of every token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        if model["type"] != "BPE" or whole["pre_tokenizer"]["type"] != "ByteLevel" or whole["pre_tokenizer"]["add_prefix_space"] or whole["normalizer"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        ids: dict[str, int] = model["vocab"]
        characters = byte_characters()
        self.of_byte = np.array([ids[c] for c in characters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        into = np.array([ids[m[0] + m[1]] for m in merges], np.int32)
        self.size = 1 + max([*ids.values(), *(a["id"] for a in whole["added_tokens"])])
        made = np.full(self.size, -1, np.int64)
        made[into] = np.arange(len(into))
        #: Whether each pair is merged later than the merges that make its parts, so that ranks rise in a word.
        self.rising = bool((np.maximum(made[left], made[right]) < np.arange(len(into))).all())
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.into = keys[order], order.astype(np.int32), into[order]
        self.special = {a["content"]: a["id"] for a in whole["added_tokens"] if a["content"]}
        back = {c: b for b, c in enumerate(characters)}
        spelled: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            spelled[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.ends = np.cumsum([len(s) for s in spelled])
        self.starts = self.ends - np.array([len(s) for s in spelled])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(PATTERN)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the sorted keys, whether it is there) of pairs."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key


def _every_second(pick: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """``pick`` without those that overlap one taken before; ``follows[k]``: pick k + 1 begins where pick k ends."""
    begins = np.flatnonzero(np.concatenate(([True], ~follows)))
    nth = np.arange(len(pick)) - np.repeat(begins, np.diff(np.append(begins, len(pick))))
    return pick[nth % 2 == 0]


def merge_by_rank(vocabulary: Vocabulary, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same result as ``merge_rounds``, where ranks rise, by one rank at a time over linked symbols."""
    n = len(symbols)
    symbols, alive = symbols.copy(), np.ones(n, bool)
    after = np.where(np.append(word[1:] == word[:-1], False), np.arange(1, n + 1), -1)
    before = np.where(np.concatenate(([False], word[1:] == word[:-1])), np.arange(-1, n - 1), -1)
    waiting: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []

    def push(at: np.ndarray) -> None:
        at = at[after[at] >= 0]
        place, there = vocabulary.lookup(symbols[at], symbols[after[at]])
        at, place = at[there], place[there]
        order = np.argsort(vocabulary.rank[place], kind="stable")
        at, rank = at[order], vocabulary.rank[place[order]]
        cuts = [*np.flatnonzero(np.diff(rank, prepend=-1)).tolist(), len(at)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if (r := int(rank[a])) not in waiting:
                heapq.heappush(heap, r)
            waiting[r].append(at[a:b])

    push(np.arange(n))
    while heap:
        r = heapq.heappop(heap)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[alive[at] & (after[at] >= 0)]
        place, there = vocabulary.lookup(symbols[at], symbols[after[at]])
        same = there & (vocabulary.rank[place] == r)
        at, place = at[same], place[same]
        if not len(at):
            continue
        into = vocabulary.into[place[0]]
        at = _every_second(at, after[at[:-1]] == at[1:])
        gone = after[at]
        symbols[at], alive[gone] = into, False
        after[at] = after[gone]
        follow = after[at] >= 0
        before[after[at[follow]]] = at[follow]
        push(np.unique(np.concatenate((before[at][before[at] >= 0], at))))
    return symbols[alive], word[alive]


def merge_rounds(vocabulary: Vocabulary, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, word of each) after all merges; symbols of a word stand together, words in rising order."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    turn = 0
    while len(symbols):
        if turn >= ROUNDS and vocabulary.rising:
            done.append(merge_by_rank(vocabulary, symbols, word))
            break
        turn += 1
        at, there = vocabulary.lookup(symbols[:-1], symbols[1:])
        rank = np.append(np.where(there & (word[:-1] == word[1:]), vocabulary.rank[at], NONE), NONE).astype(np.int32)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        sizes = np.diff(np.append(first, len(word)))
        lowest = np.minimum.reduceat(rank, first)
        open_ = np.repeat(lowest < NONE, sizes)
        if not open_.all():
            done.append((symbols[~open_], word[~open_]))
        pick = np.flatnonzero(open_ & (rank == np.repeat(lowest, sizes)))
        if not len(pick):
            break
        pick = _every_second(pick, np.diff(pick) == 1)  # picks overlap where the pair is one symbol twice
        symbols = symbols.copy()
        symbols[pick] = vocabulary.into[at[pick]]
        open_[pick + 1] = False
        symbols, word = symbols[open_], word[open_]
    if not done:
        return symbols, word
    symbols, word = (np.concatenate([d[k] for d in done]) for k in (0, 1))
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


class Encoder:
    """Texts to ids.  Words are looked up in blocks; new words of a block are merged once, together."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.number: dict[str | int, int] = {}  # of the words known so far
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> Iterator[list[str | int]]:
        """Words of a text, in lists; a special token is given as its id."""
        v, at = self.vocabulary, 0
        for found in v.split.finditer(text) if v.split else ():
            yield from self._plain(text[at : found.start()])
            yield [v.special[found[0]]]
            at = found.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG:
            yield self.vocabulary.words.findall(text)
            return
        stream = self.vocabulary.words.finditer(text)
        while part := [m[0] for m in islice(stream, WORDS)]:
            yield part

    def _block(self, words: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens of each word) of a block of words."""
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        self._learn(new)
        which = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        counts, starts = self.counts[which], self.starts[which]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        if (over := len(self.number) - KNOWN) > 0:
            for w in new[-over:]:
                del self.number[w]
            self.ids = self.ids[: self.starts[KNOWN]].copy()
            self.starts, self.counts = self.starts[:KNOWN].copy(), self.counts[:KNOWN].copy()
        return ids, counts

    def _learn(self, new: list[str | int]) -> None:
        for k, w in enumerate(new, len(self.number)):
            self.number[w] = k
        special = np.array([isinstance(w, int) for w in new], bool)
        spelled = [b"\0" if isinstance(w, int) else w.encode("utf-8", "surrogatepass") for w in new]
        symbols = self.vocabulary.of_byte[np.frombuffer(b"".join(spelled), np.uint8)]
        word = np.repeat(np.arange(len(new)), np.fromiter(map(len, spelled), np.int64, len(new)))
        plain = ~special[word]
        ids, of = merge_rounds(self.vocabulary, symbols[plain], word[plain])
        if special.any():
            ids, of = np.concatenate((ids, np.array([w for w in new if isinstance(w, int)], np.int32))), np.concatenate((of, np.flatnonzero(special)))
            order = np.argsort(of, kind="stable")
            ids, of = ids[order], of[order]
        counts = np.bincount(of, minlength=len(new))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
        self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the texts)."""
        counts = np.zeros(len(texts), np.int64)
        found, words, owners = [], [], []

        def flush():
            ids, each = self._block(words)
            found.append(ids)
            np.add.at(counts, np.array(owners, np.int64), each)
            words.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for part in self.words(text) if text else ():
                words += part
                owners += [k] * len(part)
                if len(words) >= WORDS:
                    flush()
        if words:
            flush()
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(counts)))


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of runs of ids."""
    ids = ids.astype(np.int64)
    known = (ids >= 0) & (ids < vocabulary.size)
    at = np.where(known, ids, 0)
    sizes = np.where(known, vocabulary.ends[at] - vocabulary.starts[at], 0)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    data = vocabulary.spelled[np.repeat(vocabulary.starts[at] - ends[:-1], sizes) + np.arange(int(ends[-1]))].tobytes()
    cuts = ends[offsets].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _tables(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Vocabulary(path))


def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the texts)."""
        counts = np.zeros(len(texts), np.int64)
        found, words, owners = [], [], []

        def flush():
            ids, each = self._block(words)
            found.append(ids)
            np.add.at(counts, np.array(owners, np.int64), each)
            words.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for part in self.words(text) if text else ():
                words += part
                owners += [k] * len(part)
                if len(words) >= WORDS:
                    flush()
        if words:
            flush()
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(counts)))


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of runs of ids."""
    ids = ids.astype(np.int64)
    known = (ids >= 0) & (ids < vocabulary.size)
    at = np.where(known, ids, 0)
    sizes = np.where(known, vocabulary.ends[at] - vocabulary.starts[at], 0)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    data = vocabulary.spelled[np.repeat(vocabulary.starts[at] - ends[:-1], sizes) + np.arange(int(ends[-1]))].tobytes()
    cuts = ends[offsets].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _tables(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Vocabulary(path))


def _without(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column) if column in df.columns else df


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids", keep: bool = True) -> DataFrame:
    """``df`` with the token ids of ``text_col`` as an array; without ``keep`` the text itself is left out."""
    tables = _tables(df.sparkSession, path)

    def run(batches):
        encoder = Encoder(tables.value)
        for batch in batches:
            for part in tokens.slices(batch, "__sm_text", SLICE):
                ids, offsets = encoder.encode(part.column("__sm_text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield part.drop_columns(["__sm_text"]).append_column(out, lists)

    named = df.withColumn("__sm_text", F.col(text_col))
    kept = [c for c in df.columns if c != out and (keep or c != text_col)]
    schema = df.select(*kept).withColumn(out, F.array().cast("array<int>")).schema
    return named.select(*kept, "__sm_text").mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded", keep: bool = True) -> DataFrame:
    """``df`` with the text of ``ids_col``; without ``keep`` the ids themselves are left out."""
    tables = _tables(df.sparkSession, path)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), DECODED):
                part = batch.slice(at, DECODED)
                lists = part.column("__sm_ids")
                empty = pa.array([[]], lists.type)[0]
                lists = lists.fill_null(empty)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                ids = lists.values.fill_null(-1).to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                texts = decode_ids(tables.value, ids, offsets - offsets[0])
                yield part.drop_columns(["__sm_ids"]).append_column(out, pa.array(texts, pa.string()))

    named = df.withColumn("__sm_ids", F.col(ids_col).cast("array<int>"))
    kept = [c for c in df.columns if c != out and (keep or c != ids_col)]
    return named.select(*kept, "__sm_ids").mapInArrow(run, df.select(*kept).withColumn(out, F.lit("")).schema)


def op12(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, path, keep=False)
    ids = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "ids")
    return decode(ids, path, keep=False).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
