"""Log-bilinear language model: counted on Spark, trained in numpy with noise-contrastive estimation, scored in batches.

Words become units. The ``own_words`` most frequent ones, four times the corpus' tokens to the power 0.4, have units of
their own; rarer ones share units by their last two bytes, and the end of a text is a unit. Units, by falling frequency,
are cut into about as many classes as a class has units. The model is log-bilinear in two factors:

    P(unit | context) = P(class | context) * P(unit | class, context)

The context's vector is the sum of the vectors of the units before, each weighted by its distance; from 10 million tokens
on there is one more of them for ten times the tokens. A class or unit scores the product of its vector with the
context's, plus a bias. Inside a shared unit a word has its add-one share, so every word has a probability and all of
them sum to one.

1. One pass counts words over all training texts. The table grows with the corpus and stays distributed.
2. One pass writes every text's units, so that later passes neither split nor look up its words again.
3. ``ROUNDS`` passes, each over another part of the training texts, train the model: every task goes through its texts
   in minibatches, contrasts each observed class and unit with ``NOISE`` draws from their frequencies, and adds up its
   vectors, weighted by how often it met their unit. Spark adds these sums by blocks, and the means start the next round.
4. One pass scores all texts with products of whole batches, normalised over classes and over the units of a class.

What travels with the tasks is bounded by ``LEXICON`` words: their counts (rarer ones are joined to the counts table by
word) and, as far as they have units of their own, their vectors. Below 5e12 training tokens the bound on own words is
not reached; beyond, the rest of the words share units as all rare ones do.

Null texts count as empty: the end alone. Repeated rows are scored each, and ids may be of any type or null (as the text
''). Without training texts every known count is zero and all units are alike but for the class they are in.
"""

from __future__ import annotations

import math
import zlib
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stakewise.llm.common import bounded_batches, byte_words, stored

#: Units that rare words share.
SHARED = 255
#: Words that travel with the tasks at most.
LEXICON = 500_000
RANK, NOISE, ROUNDS = 24, 16, 2
RATE = 0.05
#: Words that a task counts before it hands them on.
COUNTED = 300_000
#: Tokens that a task holds for training, and tokens of a product of matrices.
HELD, SLICE = 200_000, 16_384
#: Contexts whose scores are normalised at once.
CACHED = 1024
#: Tokens that training should see; smaller corpora are gone through as often as that takes, ``PASSES`` times at most.
SEEN, PASSES = 4_000_000, 10


def own_words(tokens: int) -> int:
    return min(LEXICON, int(4 * tokens**0.4))


def context_length(tokens: int) -> int:
    """Units before that the model sees: one more for ten times the tokens."""
    return max(2, int(math.log10(max(tokens, 1))) - 4)


def suffix(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SHARED


class Vocabulary:
    """The lexicon's words and counts, and the unit of any word; units are numbered by falling frequency.

    ``shared`` has the tokens and types of each suffix, over all words of the corpus.
    """

    def __init__(self, words: list[bytes], counts: list[int], shared: np.ndarray, tokens: int):
        order = sorted(range(len(words)), key=lambda i: (words[i] != b"", -counts[i], words[i]))
        self.words = [words[i] for i in order]
        self.counts = np.array([counts[i] for i in order] + [0], np.int64)
        first = 1 if self.words and self.words[0] == b"" else 0
        own = [i for i in range(first, min(len(self.words), first + own_words(tokens))) if self.counts[i] > 1]
        left = shared.astype(np.float64).copy()
        for i in own:
            left[suffix(self.words[i])] -= self.counts[i], 1
        #: frequencies of the end, the shared units and the own ones, as they are before they are numbered
        raw = np.concatenate([[self.counts[0] if first else 0], left[:, 0], self.counts[own]])
        number = np.empty(len(raw), np.int64)
        number[np.argsort(-raw, kind="stable")] = np.arange(len(raw))
        self.size = len(raw)
        self.frequency = np.sort(raw)[::-1] + 1
        self.end, self.of_suffix = int(number[0]), number[1 : SHARED + 1]
        self.units = np.zeros(len(self.words) + 1, np.int64)
        self.units[: len(self.words)] = self.of_suffix[[suffix(w) for w in self.words]]
        self.units[own] = number[SHARED + 1 :]
        if first:
            self.units[0] = self.end
        #: numbers in which units are written
        self.kind = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.is_shared = np.zeros(self.size, bool)
        self.is_shared[self.of_suffix] = True
        #: log10 of a shared unit's words, each counted once more, and one for all that were never seen
        self.share = np.zeros(self.size)
        self.share[self.of_suffix] = np.log10(left.sum(1) + 1)
        self.places: dict[bytes, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"places": None}

    def found(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the lexicon (-1: not there) and units."""
        if self.places is None:
            self.places = {w: i for i, w in enumerate(self.words)}
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        units = self.units[at]
        missing = np.flatnonzero(at < 0)
        units[missing] = self.of_suffix[[suffix(words[i]) for i in missing]]
        return at, units


def ordering(values: np.ndarray, below: int) -> np.ndarray:
    """What sorts values from 0 to ``below``; two bytes are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if below <= 1 << 16 else values, kind="stable")


def run_sums(ordered: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and the sums of each one's rows."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if rows.dtype == np.float32 and rows.shape[1] % 2 == 0:
        # two columns at once, as complex numbers: a step for every run and column is what takes time
        return ordered[starts], np.add.reduceat(rows.view(np.complex64), starts, axis=0).view(np.float32)
    return ordered[starts], np.add.reduceat(rows, starts, axis=0)


def segments(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, behind) of the runs of a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    return list(zip(values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True))


class Model:
    """Vectors and biases. Rows of ``unit`` and ``kind`` (the classes) are (vector, bias), so a context's vector with a one
    behind it gives their scores; ``context`` has the vectors of units as context, ``weight`` those of distances."""

    tables = ("context", "unit", "kind", "weight")

    def __init__(self, frequency: np.ndarray, context: int, rank: int = RANK, noise: int = NOISE, seed: int = 1):
        size = len(frequency)
        self.rank, self.noise = rank, noise
        self.width = math.isqrt(max(size - 1, 0)) + 1
        mass = np.add.reduceat(frequency, np.arange(0, size, self.width))
        self.share = {"kind": mass / mass.sum(), "unit": frequency / np.repeat(mass, self.width)[:size]}
        logs = {k: np.log(x).astype(np.float32) for k, x in self.share.items()}
        #: what a score has to exceed for the data to be likelier than ``noise`` draws
        self.bar = {k: x + np.float32(math.log(noise)) for k, x in logs.items()}
        self.context = np.random.default_rng(seed).normal(0, 0.3, (size, rank)).astype(np.float32)
        self.unit, self.kind = (np.concatenate([np.zeros((len(logs[k]), rank), np.float32), logs[k][:, None]], axis=1) for k in ("unit", "kind"))
        self.weight = np.repeat((1 / np.arange(1, context + 1))[:, None], rank, axis=1).astype(np.float32)

    def rows_of(self, kind: int) -> slice:
        return slice(kind * self.width, min((kind + 1) * self.width, len(self.unit)))

    def weighted(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Context vectors weighted by distance, nearest first; their sum over a context has a one behind it."""
        tables = []
        for k, weight in enumerate(self.weight):
            table = np.full((len(vectors), self.rank + 1), k == 0, np.float32)
            np.multiply(vectors, weight, out=table[:, :-1])
            tables.append(table)
        return tables

    def log_probabilities(self, units: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Natural log P(unit | units before) at ``places`` of ``units``, normalised."""
        out, tables = np.empty(len(places)), self.weighted(self.context)
        for at in range(0, len(places), SLICE):
            part = places[at : at + SLICE]
            order = ordering(units[part], len(self.unit))
            part = part[order]
            target = units[part]
            kind = target // self.width
            h = hidden(tables, [units[part - k] for k in range(1, len(tables) + 1)])
            logs = picked(h, self.kind, kind)
            for k, a, b in segments(kind):
                logs[a:b] += picked(h[a:b], self.unit[self.rows_of(k)], target[a:b] - k * self.width)
            out[at + order] = logs
        return out

    def barred(self, table: str) -> np.ndarray:
        """A table's rows, whose biases are less by what a score has to exceed."""
        rows = getattr(self, table).copy()
        rows[:, -1] -= self.bar[table]
        return rows

    def learn(self, units: np.ndarray, places: np.ndarray, steps: dict[str, np.ndarray], rng) -> None:
        """One minibatch of the noise-contrastive objective: each observed class and unit against ``noise`` draws from the
        frequencies, shared by the batch. Its slopes' steps are divided by the roots of the sums of squares in ``steps``."""
        places = places[ordering(units[places], len(self.unit))]
        target = units[places]
        kind = target // self.width
        before = [units[places - k] for k in range(1, len(self.weight) + 1)]
        met = np.zeros(len(self.context), bool)
        for units_k in before:
            met[units_k] = True
        met = np.flatnonzero(met)
        place = np.empty(len(self.context), np.int64)
        place[met] = np.arange(len(met))
        before = [place[units_k] for units_k in before]
        vectors = self.context[met]
        h = hidden(self.weighted(vectors), before)
        kinds, rows = self.barred("kind"), self.barred("unit")
        by_h, by_kind = observed(h, kinds, kind)
        more, by_unit = observed(h, rows, target)
        by_h += more
        contrasted(h, kinds, rng.multinomial(self.noise, self.share["kind"]), by_h, by_kind)
        for k, a, b in segments(kind):
            own = self.rows_of(k)
            contrasted(h[a:b], rows[own], rng.multinomial(self.noise, self.share["unit"][own]), by_h[a:b], by_unit[own])
        self.step("kind", steps, by_kind)
        self.step("unit", steps, by_unit)
        by_h = np.ascontiguousarray(by_h[:, :-1])
        sums, by_weight = np.zeros_like(vectors), np.empty_like(self.weight)
        for k, place in enumerate(before):
            order = ordering(place, len(met))
            index, found = run_sums(place[order], np.take(by_h, order, axis=0))
            by_weight[k] = np.einsum("bd,bd->d", found, np.take(vectors, index, axis=0)) / len(places)
            found *= self.weight[k]
            sums[index] += found
        self.step("weight", steps, by_weight)
        self.step("context", steps, sums, met)

    def step(self, table: str, steps: dict[str, np.ndarray], slope: np.ndarray, rows=slice(None)) -> None:
        moved = slope * slope
        squares = steps[table][rows]
        squares += moved
        steps[table][rows] = squares
        np.sqrt(squares, out=moved)
        np.divide(slope, moved, out=moved)
        moved *= np.float32(RATE)
        getattr(self, table)[rows] += moved

    def fresh_steps(self) -> dict[str, np.ndarray]:
        return {t: np.full(getattr(self, t).shape, 1e-6, np.float32) for t in self.tables}


def hidden(tables: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
    """The contexts' vectors, a one behind each, from weighted tables and the units before (nearest first)."""
    h = np.take(tables[0], before[0], axis=0)
    for table, units in zip(tables[1:], before[1:], strict=True):
        h += np.take(table, units, axis=0)
    return h


def observed(h: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes by ``h`` and by ``rows``, which have the bar taken off, of the observed targets, in order."""
    own = np.take(rows, target, axis=0)
    with np.errstate(over="ignore"):
        data = np.exp(np.einsum("bd,bd->b", h, own))
    data += 1
    np.reciprocal(data, out=data)
    own *= data[:, None]
    slope, width = np.zeros_like(rows), rows.shape[1]
    even = np.zeros((len(h), width + width % 2), np.float32)
    np.multiply(h, data[:, None], out=even[:, :width])
    index, sums = run_sums(target, even)
    slope[index] = sums[:, :width]
    return own, slope


def contrasted(h: np.ndarray, rows: np.ndarray, drawn: np.ndarray, by_h: np.ndarray, slope: np.ndarray) -> None:
    """Adds the slopes of the ``drawn`` rows to those by ``h`` and by ``rows``."""
    among = np.flatnonzero(drawn)
    kept = rows[among]
    with np.errstate(over="ignore"):
        noise = np.exp(h @ -kept.T)
    noise += 1
    np.divide(-drawn[among].astype(np.float32), noise, out=noise)
    by_h += noise @ kept
    slope[among] += noise.T @ h


def picked(h: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the normalised score of each context's target among ``rows``, by blocks that stay in the processor's cache."""
    out, one = np.empty(len(h)), np.ones(len(rows), np.float32)
    for at in range(0, len(h), CACHED):
        scores = h[at : at + CACHED] @ rows.T
        own = scores[np.arange(len(scores)), target[at : at + CACHED]]
        with np.errstate(over="ignore", under="ignore"):
            total = np.exp(scores, out=scores) @ one
        logs = np.log(total, where=(total > 1e-30) & (total < 1e30), out=np.full(len(total), np.nan, np.float32))
        far = np.flatnonzero(np.isnan(logs))
        if len(far):
            # sums beyond single precision's range
            scores = h[at + far] @ rows.T
            most = scores.max(1)
            logs[far] = most + np.log(np.exp(scores - most[:, None]).sum(1))
        out[at : at + CACHED] = own - logs
    return out


def joined_paths(paths: list[np.ndarray], end: int, context: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of all texts in a row, each behind ``context`` ends and before one, and the places to predict."""
    lead = np.full(context, end, np.int64)
    whole = np.concatenate([x for path in paths for x in (lead, path, lead[:1])])
    predicted = np.ones(len(whole), bool)
    starts = np.cumsum([0, *[len(path) + context + 1 for path in paths[:-1]]])
    predicted[(starts[:, None] + np.arange(context)).ravel()] = False
    return whole, np.flatnonzero(predicted)


def is_training(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 != 2


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all texts; the empty word is the end of a text."""

    def count(frames):
        from collections import Counter

        seen: Counter = Counter()

        def flushed():
            frame = pd.DataFrame({"word": list(seen.keys()), "n": list(seen.values())})
            seen.clear()
            return frame

        for frame in frames:
            for text in frame["text"]:
                seen.update(byte_words(text or ""))
                seen[b""] += 1
                if len(seen) > COUNTED:
                    yield flushed()
        if seen:
            yield flushed()

    return docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """The words above the least count that at most ``most`` words reach, and the end, with their counts."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect()
    least, total = None, 0
    for row in sizes:
        total += row["words"]
        if total > most:
            break
        least = row["n"]
    chosen = (F.col("n") >= least) if least is not None else F.lit(False)
    rows = counts.filter(chosen | (F.length("word") == 0)).collect()
    return [bytes(r["word"]) for r in rows], [r["n"] for r in rows]


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` (text and others) with ``units`` (those of the text's words) for ``text``, and what else comes from the lexicon:
    uid, n_tokens, n_known, the logs of the counts (base) and shares (within), and the words beyond it (rare, tf)."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    more = "uid long, n_tokens long, n_known long, base double, within double, units binary, rare array<binary>, tf array<long>"
    schema = T.StructType([*kept, *T._parse_datatype_string(more).fields])
    has_end = bool(vocabulary.words) and vocabulary.words[0] == b""
    logs = np.log10(vocabulary.counts + 1.0)
    end_log = logs[0] if has_end else 0.0

    def encode(batches):
        from collections import Counter

        import pyarrow as pa
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows, rare, tf, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                words = byte_words(text or "")
                at, own = vocabulary.found(words)
                within = float(logs[at][vocabulary.is_shared[own]].sum()) - float(vocabulary.share[own].sum())
                missing = np.flatnonzero(at < 0).tolist()
                beyond = Counter([words[i] for i in missing])
                rare.extend(beyond.keys())
                tf.extend(beyond.values())
                ends.append(len(rare))
                rows.append((uid, len(words) + 1, len(words) - len(missing) + has_end, float(logs[at].sum()) + end_log, within, own.astype(vocabulary.kind).tobytes()))
                uid += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((rare, pa.binary()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *columns, *lists], names=schema.names)

    return docs.select(*[f.name for f in kept], "text").mapInArrow(encode, schema)


def trained(taught: DataFrame, vocabulary: Vocabulary, tokens: int, rounds: int = ROUNDS) -> Model:
    """The model of all texts in ``taught`` (text)."""
    return learned(encoded(taught.select("text", part_of("text", rounds).alias("part")), vocabulary), vocabulary, tokens, rounds)


def part_of(text: str, rounds: int) -> Column:
    """The round that learns from a text."""
    return F.pmod(F.xxhash64(text), F.lit(rounds)).cast("int")


SUMS = "part string, first int, sums binary"


def learned(taught: DataFrame, vocabulary: Vocabulary, tokens: int, rounds: int = ROUNDS) -> Model:
    """The model of ``taught`` (uid, units, part)."""
    model = Model(vocabulary.frequency, context_length(tokens))
    #: no task below ``HELD`` tokens, and so few that their sums stay small against the corpus
    tasks = max(1, min(tokens // HELD, max(8, math.isqrt(tokens) // 400)))
    passes = min(PASSES, max(1, -(-SEEN // max(tokens, 1))))
    size = min(8192, max(256, tokens * passes // (tasks * rounds * 200)))
    #: rows of a block, so that the sums of all tasks for it are a few MB
    block = max(16, min(4096, 1_000_000 // (tasks * (2 * RANK + 2))))

    for turn in range(rounds):

        def learn(batches, model=model, turn=turn):
            import pyarrow as pa
            from pyspark import TaskContext

            rng = np.random.default_rng((turn, TaskContext.get().partitionId()))
            steps, met, paths, held = model.fresh_steps(), np.zeros(len(model.unit)), [], 0

            def use():
                # in the order of the texts, whatever the order in which their files are read
                paths.sort(key=lambda x: x[0])
                units, places = joined_paths([path for _, path in paths], vocabulary.end, len(model.weight))
                met[:] += np.bincount(units[places], minlength=len(met))
                for _ in range(passes):
                    shuffled = rng.permutation(places)
                    for at in range(0, len(shuffled), size):
                        model.learn(units, shuffled[at : at + size], steps, rng)
                paths.clear()

            for batch in batches:
                for uid, path in zip(batch.column("uid").to_pylist(), batch.column("units").to_pylist(), strict=True):
                    paths.append((uid, np.frombuffer(path, vocabulary.kind)))
                    held += len(paths[-1][1]) + 1
                    if held >= HELD:
                        use()
                        held = 0
            if paths:
                use()
            kinds = np.add.reduceat(met, np.arange(0, len(met), model.width))
            rows = []
            for name, weights in (("context", met), ("unit", met), ("kind", kinds), ("weight", np.full(len(model.weight), met.sum()))):
                values = getattr(model, name)
                for first in range(0, len(values) if met.any() else 0, block):
                    w = weights[first : first + block, None]
                    rows.append((name, first, np.concatenate([values[first : first + block] * w, w], axis=1).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["part", "first", "sums"])

        def added(frame: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in frame["sums"])
            return pd.DataFrame({"part": frame["part"].iloc[:1], "first": frame["first"].iloc[:1], "sums": [total.tobytes()]})

        part = taught.filter(F.col("part") == turn).select("uid", "units").coalesce(tasks)
        sums = part.mapInArrow(learn, SUMS).groupBy("part", "first").applyInPandas(added, SUMS)
        for row in sums.collect():
            values = getattr(model, row["part"])
            got = np.frombuffer(row["sums"]).reshape(-1, values.shape[1] + 1)
            some = np.flatnonzero(got[:, -1])
            values[row["first"] + some] = got[some, :-1] / got[some, -1:]
    return model


def score_documents(docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    ``training`` marks the rows to learn from (default: by the id's CRC-32, six of seven).
    """
    bounded_batches(docs.sparkSession)
    learn = is_training(F.col(id_col)) if training is None else F.coalesce(training, F.lit(False))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), learn.alias("learn"))
    taught = named.filter("learn")
    counts = stored(count_words(taught), "counts")
    of_suffix = (F.crc32(F.substring("word", -2, 2)) % SHARED).cast("int")
    sums = counts.groupBy(F.when(F.length("word") > 0, of_suffix).alias("suffix")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    shared = np.zeros((SHARED, 2))
    for r in sums:
        if r["suffix"] is not None:
            shared[r["suffix"]] = r["n"], r["v"]
    train_tokens, types = sum(r["n"] for r in sums), sum(r["v"] for r in sums)
    vocabulary = Vocabulary(*lexicon(counts, LEXICON), shared, train_tokens)
    texts = stored(encoded(named.select("*", part_of("text", ROUNDS).alias("part")), vocabulary), "encoded")
    model = learned(texts.filter("learn"), vocabulary, train_tokens)
    per_token = np.log10(train_tokens + types + 1)
    plain = texts.drop("part", "rare", "tf")
    schema = T.StructType([f for f in plain.schema.fields if f.name not in ("within", "units")]).add("score", "double")

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            paths = [np.frombuffer(path, vocabulary.kind) for path in batch.column("units").to_pylist()]
            units, places = joined_paths(paths, vocabulary.end, len(model.weight))
            owner = np.repeat(np.arange(len(paths)), [len(path) + 1 for path in paths])
            found = np.bincount(owner, model.log_probabilities(units, places), len(paths)) / math.log(10)
            columns = [batch.column(c) for c in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found + batch.column("within").to_numpy())], names=schema.names)

    rows = stored(plain.mapInArrow(score, schema), "scored")
    rare = texts.select("uid", F.inline(F.arrays_zip("rare", "tf"))).select("uid", F.col("rare").alias("word"), "tf").join(counts, "word")
    more = rare.groupBy("uid").agg(F.sum("tf").alias("known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("log"))
    out = rows.join(more, "uid", "left")
    log = F.coalesce("log", F.lit(0.0))
    return out.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") - float(per_token) * F.col("n_tokens") + log).alias("base_score"), (F.col("score") + log).alias("score"),
    )
