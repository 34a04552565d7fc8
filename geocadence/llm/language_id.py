"""Language identification by a linear-chain conditional random field over words.

Each word has affix, n-gram and lexicon features; transitions between the languages of neighbouring
words are learned. Forward-backward gives every word of a text, code-switched or not, its distribution
over languages; the text's language is that of most of its words' probability. The lexicon counts words
per language over all training documents in hashed buckets; the weights are fitted on a bounded sample
by mixing the parameters of stochastic gradient descent on shards. Training sees the sampled texts as they
are and, cut into runs of words that are shuffled, as texts that move between languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, numbered, remainder, small_batches, staged

#: Buckets of the lexicon and of n-gram weights, words that forward-backward takes in one stretch, and
#: letters of an item: a longer run of letters is several items of the chain, one after the other.
LEXICON, BUCKETS, STRETCH, LETTERS = 1 << 15, 1 << 14, 1024, 24
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_OUT = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"
_LABELS = "doc_id long, words array<string>, langs array<string>, scores array<double>"


def items(text: str | None) -> list[str]:
    """The items of a text: words with a letter, lower-cased, cut every ``LETTERS`` characters."""
    found = [w for w in _WORD.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]
    if max(map(len, found), default=0) <= LETTERS:
        return found
    return [w[i : i + LETTERS] for w in found for i in range(0, len(w), LETTERS)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters as a matrix, lengths)."""
    return np.array(words, f"<U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS).astype(np.uint64), np.array([len(w) for w in words])


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the features of each word, -1 for none; bucket of the word in the lexicon)."""
    code, n = _codes(words)
    at, cols = np.arange(len(words)), []
    last = lambda k: code[at, np.maximum(n - k, 0)]
    a, b, c = (code[:, i] for i in range(3))
    x, y, z = last(1), last(2), last(3)
    for kind, need, h in ((1, 1, a), (2, 2, a * 65599 + b), (3, 3, (a * 65599 + b) * 65599 + c), (4, 1, x), (5, 2, y * 65599 + x), (6, 3, (z * 65599 + y) * 65599 + x)):
        cols.append(np.where(n >= need, (_spread(h * np.uint64(8) + np.uint64(kind)) >> np.uint64(20)).astype(np.int64) % BUCKETS, -1))
    whole = np.zeros(len(words), np.uint64)
    for i in range(int(n.max(initial=0))):
        whole = np.where(i < n, _spread(whole + code[:, i] + np.uint64(1)), whole)
        for size in (2, 3):
            if i + size <= LETTERS:
                h = code[:, i] * np.uint64(65599) + code[:, i + 1]
                h = h * np.uint64(65599) + code[:, i + 2] if size == 3 else h
                cols.append(np.where(i + size <= n, (_spread(h * np.uint64(8) + np.uint64(6 - size)) >> np.uint64(18)).astype(np.int64) % BUCKETS, -1))
    return np.column_stack(cols), ((_spread(whole) >> np.uint64(24)) % np.uint64(LEXICON)).astype(np.int64)


class Field:
    """Weights of the field: n-grams and affixes (bucket x language), lexicon, bias, transitions."""

    def __init__(self, langs: list[str], lexicon: np.ndarray, weights: np.ndarray | None = None):
        self.langs, self.lexicon, k = langs, lexicon, len(langs)
        self.size = BUCKETS * k + 1 + k + k * k
        flat = np.zeros(self.size) if weights is None else weights.copy()
        if weights is None:
            flat[BUCKETS * k] = 0.5
        self.flat = flat
        self.grams, self.lex = flat[: BUCKETS * k].reshape(BUCKETS, k), flat[BUCKETS * k : BUCKETS * k + 1]
        self.bias, self.moves = flat[BUCKETS * k + 1 : BUCKETS * k + 1 + k], flat[-k * k :].reshape(k, k)

    def emissions(self, buckets: np.ndarray, entry: np.ndarray) -> np.ndarray:
        out = self.bias + self.lex * self.lexicon[entry]
        for column in buckets.T:
            has = column >= 0
            out[has] += self.grams[column[has]]
        return out

    def posteriors(self, emissions: np.ndarray, chains: np.ndarray, moves: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(distribution of each word, with ``moves`` expected transitions); ``chains``: words of the consecutive chains.

        A chain runs in stretches of up to ``STRETCH`` words, all stretches at once; the stretches of a longer
        chain first pass their ends on to one another by the products of their matrices.
        """
        k = len(self.langs)
        chains = chains[chains > 0]
        parts = -(-chains // STRETCH)
        head = np.cumsum(parts) - parts  # first stretch of each chain
        lengths = np.full(int(parts.sum()), STRETCH)
        lengths[head + parts - 1] = chains - (parts - 1) * STRETCH
        starts = np.cumsum(lengths) - lengths
        follows = np.ones(len(lengths), bool)
        follows[head] = False
        move = np.exp(self.moves - self.moves.max())
        local = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        ahead, back = np.zeros_like(local), np.ones_like(local)
        entry, leave = np.ones((len(lengths), k)), np.ones((len(lengths), k))
        if (parts > 1).any():
            product = self._products(np.repeat(parts > 1, parts), follows, starts, lengths, local, move)
            for chain in np.flatnonzero(parts > 1).tolist():
                one, n = head[chain], parts[chain]
                for j in range(1, n):
                    x = entry[one + j - 1] @ product[one + j - 1]
                    entry[one + j] = x / x.sum()
                for j in range(n - 2, -1, -1):
                    x = product[one + j + 1] @ leave[one + j + 1]
                    leave[one + j] = x / x.sum()
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, entry, leave, follows = (x[order] for x in (starts, lengths, entry, leave, follows))
        back[starts + lengths - 1] = leave
        alive = np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")
        for t, n in enumerate(alive.tolist()):
            i = starts[:n] + t
            x = (np.where(follows[:, None], entry @ move, 1.0) if t == 0 else ahead[i - 1] @ move) * local[i]
            ahead[i] = x / x.sum(axis=1, keepdims=True)
        for t in range(len(alive) - 2, -1, -1):
            i = starts[: alive[t + 1]] + t
            x = (local[i + 1] * back[i + 1]) @ move.T
            back[i] = x / x.sum(axis=1, keepdims=True)
        out = np.zeros((k, k))
        if moves:
            inner = np.ones(len(local), bool)
            inner[np.cumsum(chains) - 1] = False
            i = np.flatnonzero(inner)
            joint = ahead[i][:, :, None] * move * (local[i + 1] * back[i + 1])[:, None, :]
            out = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        both = ahead * back
        return both / both.sum(axis=1, keepdims=True), out

    @staticmethod
    def _products(wanted: np.ndarray, follows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, local: np.ndarray, move: np.ndarray) -> np.ndarray:
        """The product of the matrices of the wanted stretches, scaled: it takes the vector before a stretch to its end."""
        k, order = local.shape[1], np.flatnonzero(wanted)
        order = order[np.argsort(-lengths[order], kind="stable")]
        out = np.tile(np.eye(k), (len(lengths), 1, 1))
        at, n = starts[order], lengths[order]
        x = np.where(follows[order][:, None, None], move, np.eye(k)) * local[at][:, None, :]
        for t in range(1, int(n.max())):
            live = int(np.searchsorted(-n, -t, side="left"))
            x[:live] = (x[:live] @ move) * local[at[:live] + t][:, None, :]
            x[:live] /= x[:live].sum(axis=(1, 2), keepdims=True)
        out[order] = x
        return out


def _chains(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct items, index of each item, items of each text)."""
    known: dict[str, int] = {}
    index, counts = [], []
    for text in texts:
        own = [known.setdefault(w, len(known)) for w in items(text)]
        index += own
        counts.append(len(own))
    return list(known), np.array(index, np.int64), np.array(counts, np.int64)


def _lexicon(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    total, place = np.zeros((len(langs), LEXICON), np.int64), {x: i for i, x in enumerate(langs)}
    for batch in small_batches(batches, "text", 4 << 20):
        words, index, counts = _chains(batch.column("text").to_pylist())
        if not len(index):
            continue
        entry = features_lexicon(words)[index]
        lang = np.repeat([place[x] for x in batch.column("lang").to_pylist()], counts)
        np.add.at(total, (lang, entry), 1)
    rows, buckets = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(buckets.astype(np.int32)), pa.array(total[rows, buckets])], ["lang", "bucket", "n"])


def features_lexicon(words: list[str]) -> np.ndarray:
    """The lexicon buckets alone."""
    code, n = _codes(words)
    whole = np.zeros(len(words), np.uint64)
    for i in range(int(n.max(initial=0))):
        whole = np.where(i < n, _spread(whole + code[:, i] + np.uint64(1)), whole)
    return ((_spread(whole) >> np.uint64(24)) % np.uint64(LEXICON)).astype(np.int64)


def shuffled_runs(gold: np.ndarray, rng: np.random.Generator, mean: int = 12) -> np.ndarray:
    """Places of all words, in runs of about ``mean`` words of one text that come in random order."""
    ends = np.cumsum(rng.geometric(1 / mean, max(1, 2 * len(gold) // mean + 8)))
    cuts = np.unique(np.concatenate([[0, len(gold)], ends[ends < len(gold)], np.flatnonzero(gold[1:] != gold[:-1]) + 1]))
    runs = rng.permutation(len(cuts) - 1)
    return np.concatenate([np.arange(cuts[r], cuts[r + 1]) for r in runs])


def _fit(batches: Iterator[pa.RecordBatch], langs: list[str], lexicon: np.ndarray, weights: np.ndarray, rate: float, decay: float) -> Iterator[pa.RecordBatch]:
    """One pass of AdaGrad over a shard; gives its weights."""
    field, k, rng = Field(langs, lexicon, weights), len(langs), np.random.default_rng(11)
    place, squares, seen = {x: i for i, x in enumerate(langs)}, np.full(field.size, 1e-2), 0
    for batch in small_batches(batches, "text", 64 << 10, 16):
        words, index, counts = _chains(batch.column("text").to_pylist())
        if not len(index):
            continue
        seen += len(counts)
        buckets, entry = features(words)
        gold = np.repeat([place[x] for x in batch.column("lang").to_pylist()], counts)
        mixed = shuffled_runs(gold, rng)
        for index, gold, chains in ((index, gold, counts[counts > 0]), (index[mixed], gold[mixed], np.diff(np.append(np.arange(0, len(gold), 128), len(gold))))):
            found, moves = field.posteriors(field.emissions(buckets, entry)[index], chains, moves=True)
            error = -found
            error[np.arange(len(gold)), gold] += 1
            slope = np.zeros_like(field.flat)
            by_word = np.column_stack([np.bincount(index, error[:, j], len(words)) for j in range(k)])
            grams = slope[: BUCKETS * k].reshape(BUCKETS, k)
            for column in buckets.T:
                has = column >= 0
                np.add.at(grams, column[has], by_word[has])
            slope[BUCKETS * k] = (error * lexicon[entry[index]]).sum()
            slope[BUCKETS * k + 1 : BUCKETS * k + 1 + k] = error.sum(axis=0)
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(chains) - 1] = False
            at = np.flatnonzero(inner)
            went = np.bincount(gold[at] * k + gold[at + 1], minlength=k * k)
            slope[-k * k :] = went - moves.reshape(-1)
            slope = slope / len(gold) - decay * field.flat
            squares += slope**2
            field.flat += rate * slope / np.sqrt(squares)
    yield pa.RecordBatch.from_arrays([pa.array([field.flat.tobytes()] if seen else [], pa.binary()), pa.array([seen] if seen else [], pa.int64())], ["weights", "n"])


def train(docs: DataFrame, per_lang: int = 400, rounds: int = 3, splits: int = 8, rate: float = 0.3, decay: float = 1e-5) -> Field | None:
    """A field fitted on ``text, lang`` (both non-null).

    Lexicon: all rows. Weights: up to ``per_lang`` different texts of each language, those of the smallest
    hashes; a text with several languages is taken for each. The driver sees a row for each language and
    the ``splits`` weight vectors of each round.
    """
    spark = docs.sparkSession
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    langs = sorted(r[0] for r in docs.select("lang").distinct().collect())
    if not langs:
        return None
    counted = docs.mapInArrow(partial(_lexicon, langs=langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((LEXICON, len(langs)))
    table[counted["bucket"].to_numpy(), counted["lang"].to_numpy()] = counted["n"].to_numpy()
    share = (table + 0.05) / (table.sum(axis=0) + 0.05 * LEXICON)
    lexicon = np.log(share / share.sum(axis=1, keepdims=True))
    lexicon -= lexicon.mean(axis=1, keepdims=True)
    keyed = docs.select("text", "lang", F.xxhash64("text").alias("h"))
    texts = staged(spark, keyed.select("lang", "h").distinct(), "language-hashes")
    # Hashes are even, so the smallest twice per_lang of them lie below this share of their range.
    counts = texts.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    low = texts.join(F.broadcast(counts), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 < (2 * per_lang + 64) / F.col("n"))
    picked = low.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("i") <= per_lang).select("lang", "h")
    # At most per_lang hashes of each language: small enough to send to all tasks whatever the table.
    sample = keyed.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = staged(spark, sample, "language-sample")
    dealt = sample.repartition(splits, F.pmod(F.xxhash64("h"), F.lit(splits)).cast("int")).sortWithinPartitions("h", "lang").select("text", "lang")
    field = Field(langs, lexicon)
    for i in range(rounds):
        parts = dealt.mapInArrow(partial(_fit, langs=langs, lexicon=lexicon, weights=field.flat, rate=rate / (i + 1), decay=decay), "weights binary, n long").collect()
        if parts:
            field = Field(langs, lexicon, np.average([np.frombuffer(p["weights"]) for p in parts], axis=0, weights=[p["n"] for p in parts]))
    discard(sample, texts)
    return field


def _predicted(texts: pa.Array, field: Field | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, items, moves between languages of the likeliest labels) of each text."""
    words, index, counts = _chains(texts.to_pylist())
    pred, score, switches = ["und"] * len(counts), np.zeros(len(counts)), np.zeros(len(counts), np.int64)
    if field and len(index):
        found, _ = field.posteriors(field.emissions(*features(words))[index], counts)
        total = np.cumsum(np.vstack([np.zeros(len(field.langs)), found]), axis=0)
        ends = np.cumsum(counts)
        mean = (total[ends] - total[ends - counts]) / np.maximum(counts, 1)[:, None]
        best = mean.argmax(axis=1)
        pred = [field.langs[b] if n else "und" for b, n in zip(best.tolist(), counts.tolist(), strict=True)]
        score = np.where(counts > 0, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
        own = found.argmax(axis=1)
        moved = np.append(0, np.cumsum(np.append(0, own[1:] != own[:-1])))
        switches = np.where(counts > 0, moved[ends] - moved[np.minimum(ends - counts + 1, ends)], 0)
    return pred, score, counts, switches


def _predict(batches: Iterator[pa.RecordBatch], field: Field | None) -> Iterator[pa.RecordBatch]:
    field = Field(field.langs, field.lexicon, field.flat) if field else None
    for batch in small_batches(batches, "text", 2 << 20):
        found = _predicted(batch.column("text"), field)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, found)], [x.split()[0] for x in _OUT.split(", ")])


def _accepted(batches: Iterator[pa.RecordBatch], field: Field | None, least: float, text: str) -> Iterator[pa.RecordBatch]:
    field = Field(field.langs, field.lexicon, field.flat) if field else None
    for batch in small_batches(batches, text, 512 << 10):
        pred, score, _, _ = _predicted(batch.column(text), field)
        yield batch.filter(pa.array((np.array(pred) != "und") & (score >= least)))


def _label(batches: Iterator[pa.RecordBatch], field: Field | None) -> Iterator[pa.RecordBatch]:
    field = Field(field.langs, field.lexicon, field.flat) if field else None
    for batch in small_batches(batches, "text", 2 << 20):
        words, index, counts = _chains(batch.column("text").to_pylist())
        found = field.posteriors(field.emissions(*features(words))[index], counts)[0] if field and len(index) else np.ones((len(index), 1))
        langs, best = (field.langs if field else ["und"]), found.argmax(axis=1)
        cuts = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        flat = (pa.array([words[i] for i in index.tolist()], pa.string()), pa.array([langs[b] for b in best.tolist()], pa.string()), pa.array(found[np.arange(len(best)), best] if field else np.zeros(len(best))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.ListArray.from_arrays(cuts, x) for x in flat)], [x.split()[0] for x in _LABELS.split(", ")])


def label_words(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, words, langs, scores: the items of each text, in order, each with its likeliest language under
    ``field`` (of ``train``) and that language's probability. Null texts and texts without letters have
    empty lists; without a field every word is ``und`` with score 0. Other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(partial(_label, field=field), _LABELS)


def identify(docs: DataFrame, folds: int = 5, held: int = 0, **fit: float) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_switches: one row per row of ``docs`` (doc_id, text, lang).

    Learns from non-null text and lang of documents whose crc32 of the id's decimal text modulo ``folds``
    is not ``held`` (a null id has no fold and is learned from). Words are runs of letters; a null text or
    one without letters is ``und`` with score 0, as is any text if there is nothing to learn from. Ties go
    to the language first in order. score is the mean probability of the language over the words, n_switches
    how often neighbouring words differ in their likeliest language. Repeated rows each get a row; an empty
    table gives none; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (remainder(F.col("doc_id"), folds) == held).alias("held_out"))
    field = train(docs.where("not held_out"), **fit)
    return docs.select("doc_id", "held_out", "text").mapInArrow(partial(_predict, field=field), _OUT)


def accepted(docs: DataFrame, least: float = 0.5, folds: int = 5, held: int = 0, **fit: float) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, with all columns.

    Null texts and texts without letters go, as do all if there is nothing to learn from; repeated rows are
    each judged. Columns may have any names; an empty table gives no rows.
    """
    field = train(docs.where(remainder(F.col("doc_id"), folds) != held), **fit)
    names, schema = numbered(docs.schema)
    how = partial(_accepted, field=field, least=least, text=names[docs.columns.index("text")])
    return docs.toDF(*names).mapInArrow(how, schema).toDF(*docs.columns)
