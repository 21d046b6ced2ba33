"""Text decoded with the wrong character encoding (problem 10).

A record's text was, with small probability, passed through a *chain*: encoded
with one encoding and decoded with another, once or twice, in whole or in part.
The chain is latent.  Expectation-maximisation estimates

* a character model of words as they should be: counts of character bigrams
  and trigrams in words with characters beyond ASCII, each word weighted by the
  probability that it is unharmed,
* how often each chain occurs per source and field, drawn to the overall share
  where a source has little to tell,

first over the words of every source and field, until the shares stay as they
are, then over the records: words that a chain turns into likelier words are
evidence for it, and weak evidence adds up within the record and, by the chain's
share, within the source.  A record whose posterior of being unharmed is below
one half is reported and repaired word by word with its most probable chain and
the fitted model.  U+FFFD can't be restored: it marks a record at once.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekline.llm.sums import CHUNKS, added, chunks_of, gathered
from seekline.plans.lineage import materialize, release
from seekline.sources.tables import partitions, spread

#: Chains as (written as, read as), applied again for each further pair. Fixed values.
CHAINS: list[tuple[str, tuple[tuple[str, str], ...]]] = [
    ("utf8_cp1252", (("utf-8", "cp1252"),)),
    ("utf8_latin1", (("utf-8", "latin-1"),)),
    ("utf8_cp1250", (("utf-8", "cp1250"),)),
    ("utf8_cp1251", (("utf-8", "cp1251"),)),
    ("utf8_cp1253", (("utf-8", "cp1253"),)),
    ("utf8_cp1254", (("utf-8", "cp1254"),)),
    ("utf8_cp437", (("utf-8", "cp437"),)),
    ("utf8_cp850", (("utf-8", "cp850"),)),
    ("utf8_mac", (("utf-8", "mac_roman"),)),
    ("utf8_koi8r", (("utf-8", "koi8-r"),)),
    ("utf8_cp866", (("utf-8", "cp866"),)),
    ("utf8_cp1252_twice", (("utf-8", "cp1252"), ("utf-8", "cp1252"))),
    ("utf8_latin1_twice", (("utf-8", "latin-1"), ("utf-8", "latin-1"))),
    ("utf8_latin1_cp1252", (("utf-8", "latin-1"), ("utf-8", "cp1252"))),
    ("cp1252_cp1251", (("cp1252", "cp1251"),)),
    ("cp1252_cp1250", (("cp1252", "cp1250"),)),
    ("cp1252_cp1253", (("cp1252", "cp1253"),)),
    ("cp1252_cp437", (("cp1252", "cp437"),)),
    ("cp1252_cp850", (("cp1252", "cp850"),)),
    ("cp1252_mac", (("cp1252", "mac_roman"),)),
    ("cp1252_koi8r", (("cp1252", "koi8-r"),)),
    ("cp1252_cp866", (("cp1252", "cp866"),)),
    ("mac_cp1252", (("mac_roman", "cp1252"),)),
    ("mac_latin1", (("mac_roman", "latin-1"),)),
    ("cp437_cp1252", (("cp437", "cp1252"),)),
    ("cp437_latin1", (("cp437", "latin-1"),)),
    ("cp850_cp1252", (("cp850", "cp1252"),)),
    ("cp1250_cp1252", (("cp1250", "cp1252"),)),
    ("cp1251_cp1252", (("cp1251", "cp1252"),)),
]
NAMES = [name for name, _ in CHAINS]
#: Counters of the character model: 4 MB whatever the input.
SLOTS = 1 << 19
LOST = "�"
#: A word is what ASCII blanks separate; a no-break space may be half of a character.
_TOKEN = re.compile(r"[^ \t\r\n\f\v]*[^\x00-\x7f][^ \t\r\n\f\v]*")


#: Longer stretches without a blank are looked at in pieces of at most this length, so none costs more than its length.
PIECE = 200
#: Pieces end before an ASCII character, which is never part of a longer one, where there is one.
_PIECES = re.compile(r"(?s).{1,%d}(?=[\x00-\x7f])|.{1,%d}" % (PIECE, PIECE))


def _pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else _PIECES.findall(word)


def _words(text: str) -> Iterator[str]:
    """The words of the whole text with characters beyond ASCII, very long ones in pieces."""
    for w in _TOKEN.findall(text):
        for x in _pieces(w):
            if len(w) <= PIECE or not x.isascii():
                yield x


def _high_half(encoding: str) -> dict[int, str]:
    """Characters of the bytes 80 to FF; a byte the code page lacks passes through as a control character."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            if b < 0xA0:
                out[b] = chr(b)
    return out


@functools.cache
def _utf8_reader(read: str):
    """A pattern of character runs that are whole UTF-8 sequences when read byte by byte in ``read``, and the bytes of its characters."""
    chars = _high_half(read)
    span = lambda lo, hi: "[" + "".join(re.escape(chars[b]) for b in range(lo, hi) if b in chars) + "]"
    more = span(0x80, 0xC0)
    pattern = re.compile(f"{span(0xC2, 0xE0)}{more}|{span(0xE0, 0xF0)}{more}{{2}}|{span(0xF0, 0xF5)}{more}{{3}}")
    return pattern, {c: b for b, c in chars.items()}


@functools.cache
def _byte_reader(written: str, read: str) -> dict[str, str]:
    a, b = _high_half(read), _high_half(written)
    return {a[k]: b[k] for k in a if k in b}


def _undo_once(word: str, written: str, read: str) -> str | None:
    if written == "utf-8":
        pattern, back = _utf8_reader(read)

        def whole(m):
            try:
                return bytes(back[c] for c in m.group()).decode("utf-8")
            except UnicodeDecodeError:
                return m.group()

        out = pattern.sub(whole, word)
        return out if out != word else None
    table = _byte_reader(written, read)
    out = []
    for c in word:
        if c >= "\x80":
            c = table.get(c)
            if c is None:
                return None
        out.append(c)
    return "".join(out)


def undo(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The word before the chain, or None where it can't have come through it."""
    for written, read in reversed(chain):
        word = _undo_once(word, written, read)
        if word is None:
            return None
    return word


def _kind(c: str) -> str:
    """A character's script and kind in one letter."""
    if c < "\x80":
        return "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else c if c in "^$" else "p"
    if c.isalpha():
        n = ord(c)
        if n < 0x250:
            return "e" if c.islower() else "E"
        return "g" if 0x370 <= n < 0x400 else "c" if 0x400 <= n < 0x530 else "o"
    return unicodedata.category(c)


@functools.lru_cache(1 << 16)
def _slots(word: str) -> np.ndarray:
    """Counter places, one row each, of a word's character trigrams, their contexts, bigrams and theirs, and of trigrams and contexts of kinds."""
    w, kinds = "^^" + word.lower() + "$", ["^", "^", *map(_kind, word), "$"]
    if len(w) != len(kinds):
        w = "^^" + word + "$"
    h, out = xxhash.xxh3_64_intdigest, []
    for i in range(2, len(w)):
        a, b, c = kinds[i - 2 : i + 1]
        out.append([h(x) % SLOTS for x in ("3" + w[i - 2 : i + 1], "2" + w[i - 2 : i], "b" + w[i - 1 : i + 1], "u" + w[i - 1], f"K{a}.{b}.{c}", f"k{a}.{b}")])
    return np.array(out, np.int64).T


class CharacterModel:
    """Probability of a word: characters given two before them, backed off to one and to a flat rest, and kinds of characters likewise."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.known = counts, {}

    def log_probability(self, word: str) -> float:
        p = self.known.get(word)
        if p is None:
            if len(self.known) > 200_000:
                self.known.clear()
            tri, ctx, bi, uni, kind, before = (self.counts[x].astype(np.float64) for x in _slots(word))
            two = (bi + 1e-4) / (uni + 1.0)
            p = self.known[word] = float(np.log((tri + 2.0 * two) / (ctx + 2.0)).sum() + np.log((kind + 0.01) / (before + 1.0)).sum())
        return p


@functools.lru_cache(1 << 16)
def candidates(word: str) -> dict[int, str]:
    """What each chain that may have made the word would restore, by the chain's number.

    A single symbol has no context that could tell one code page from another,
    so it is no evidence for a chain between single-byte code pages.
    """
    out = {}
    for k, (_, chain) in enumerate(CHAINS):
        if len(word) == 1 and chain[0][0] != "utf-8":
            continue
        before = undo(word, chain)
        if before is not None and before != word and LOST not in before:
            out[k] = before
    return out


def _word_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with characters beyond ASCII and their counts by field and source, pre-aggregated."""
    for batch in batches:
        counts: dict[tuple[str, str, str], int] = {}
        for field, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if text and not text.isascii():
                for w in _words(text):
                    if LOST not in w:
                        counts[field, source, w] = counts.get((field, source, w), 0) + 1
        columns = list(zip(*counts)) or [(), (), ()]
        yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.string()) for n, c in zip(("field", "source", "word"), columns)} | {"n": pa.array(list(counts.values()), pa.int64())})


WIDTH = len(CHAINS) + 1
_START = np.array([0.01 / len(CHAINS)] * len(CHAINS) + [0.99])


def _expected(model, prior):
    """E-step over the words of each field and source: expected unharmed occurrences of each word, then of each chain by field and source."""

    def run(batches):
        old = CharacterModel(model.value)
        for batch in batches:
            weights: dict[str, float] = {}
            shares: dict[tuple[str, str], np.ndarray] = {}
            sums: dict[tuple[str, str], np.ndarray] = {}
            for field, source, word, n, own in zip(*(batch.column(i).to_pylist() for i in range(5))):
                share = shares.get((field, source))
                if share is None:
                    share = shares[field, source] = np.log(_drawn(own, prior.value, 1000.0))
                who, score = [WIDTH - 1], [share[-1] + old.log_probability(word)]
                for k, before in candidates(word).items():
                    who.append(k)
                    score.append(share[k] + old.log_probability(before))
                p = np.exp(np.array(score) - max(score))
                p /= p.sum()
                weights[word] = weights.get(word, 0.0) + p[0] * n
                at = sums.setdefault((field, source), np.zeros(WIDTH))
                at[who] += p * n
            m, k = len(weights), len(sums)
            yield pa.RecordBatch.from_pydict({
                "word": pa.array([*weights, *[None] * k], pa.string()), "n": pa.array([*weights.values(), *[None] * k], pa.float64()),
                "field": pa.array([*[None] * m, *[f for f, _ in sums]], pa.string()), "source": pa.array([*[None] * m, *[x for _, x in sums]], pa.string()),
                "sums": pa.array([*[None] * m, *[v.tolist() for v in sums.values()]], pa.list_(pa.float64())),
            })

    return run


#: Counters of a model that are added up together.
SLOT_CHUNK = 1 << 14


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS)
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n > 1e-3:
                np.add.at(counts, _slots(word).ravel(), n)
    yield chunks_of(counts.astype(np.float32), SLOT_CHUNK)


def _fitted(words: DataFrame):
    """M-step: the character model of words (word, n), as a broadcast of SLOTS counters."""
    counts = gathered(added(words.mapInArrow(_slot_counts, CHUNKS), np.float32, np.float64), SLOTS, np.float64)
    return words.sparkSession.sparkContext.broadcast(counts.astype(np.float32))


def _summed(column: str) -> list:
    return [F.sum(F.col(column)[i]) for i in range(WIDTH)]


def _drawn(sums: list | None, prior: np.ndarray, weight: float) -> np.ndarray:
    """A source's shares of the chains from its expected counts, drawn to the overall ones as if those had been seen ``weight`` times there."""
    if sums is None:
        return prior
    seen = np.array(sums)
    return (seen + weight * prior) / (seen.sum() + weight)


def _with_shares(rows: DataFrame, shares: DataFrame | None, by: str, salts: int = 8) -> DataFrame:
    """``rows`` with their source's expected counts of the chains as ``own``; a source may hold a third of all rows, so it is split by ``by``."""
    if shares is None:
        return rows.withColumn("own", F.lit(None).cast("array<double>"))
    salted = shares.withColumnRenamed("sums", "own").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted, ["field", "source", "salt"], "left").drop("salt")


def _evidence(model):
    """Per record and field, the log-likelihood ratio of every chain against no chain, each word being harmed or not."""

    def run(batches):
        m = CharacterModel(model.value)
        remembered: dict[str, dict[int, float]] = {}
        for batch in batches:
            keys, fields, sources, lost, ratios = [], [], [], [], []
            for key, field, source, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not text or text.isascii():
                    continue
                total = np.zeros(len(CHAINS))
                gone = 0
                for w in _words(text):
                    if LOST in w:
                        gone += 1
                        continue
                    gain = remembered.get(w)
                    if gain is None:
                        if len(remembered) > 200_000:
                            remembered.clear()
                        base = m.log_probability(w)
                        gain = remembered[w] = {k: m.log_probability(b) - base for k, b in candidates(w).items()}
                    for k, g in gain.items():
                        # The word came through the chain or was left alone: the text may be harmed in part.
                        total[k] += np.logaddexp(g, 0.0) - 0.6931 if g > -50 else -0.6931
                if gone or total.max() > 0:
                    keys.append(key)
                    fields.append(field)
                    sources.append(source)
                    lost.append(gone)
                    ratios.append(total.tolist())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "field": pa.array(fields, pa.string()), "source": pa.array(sources, pa.string()), "lost": pa.array(lost, pa.int32()), "ratios": pa.array(ratios, pa.list_(pa.float64()))})

    return run


def _posterior(prior):
    def run(batches):
        for batch in batches:
            ids, fields, sources, lost, ratios, own = (batch.column(i).to_pylist() for i in range(6))
            chain, p_ok = [], []
            for ratio, share in zip(ratios, own):
                pi = _drawn(share, prior.value, 20.0)
                score = np.append(np.log(pi[:-1]) + np.array(ratio), np.log(pi[-1]))
                p = np.exp(score - score.max())
                p /= p.sum()
                chain.append(p.tolist())
                p_ok.append(float(p[-1]))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "field": pa.array(fields, pa.string()), "source": pa.array(sources, pa.string()), "lost": pa.array(lost, pa.int32()), "posterior": pa.array(chain, pa.list_(pa.float64())), "unharmed": pa.array(p_ok, pa.float64())})

    return run


class Fit(NamedTuple):
    """What expectation-maximisation found: the character model, and for records with evidence their posteriors."""

    model: object
    records: DataFrame


def _moved(old: np.ndarray, new: np.ndarray, tolerance: float) -> bool:
    """Whether the shares of the chains still move, measured against what is harmed at all."""
    return float(np.abs(new - old).sum()) > tolerance * max(1.0 - float(new[-1]), 1e-6)


def fit(docs: DataFrame, fields: tuple[str, ...] = ("text",), source: str = "source", tolerance: float = 0.02, most: int = 50) -> Fit | None:
    """Fit the model over all records; None where no text has characters beyond ASCII.

    Either loop ends when the shares of the chains move by less than
    ``tolerance`` of what is harmed, and with a warning after ``most`` rounds:
    every round's estimates are valid, later ones are closer.
    """
    spark = docs.sparkSession
    long = None
    for f in fields:
        one = docs.select("doc_id", F.lit(f).alias("field"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(f).alias("text"))
        long = one if long is None else long.unionByName(one)
    long = spread(long)
    words = materialize(long.select("field", "source", "text").mapInArrow(_word_tables, "field string, source string, word string, n long").groupBy("field", "source", "word").agg(F.sum("n").alias("n")), "words")
    if words.isEmpty():
        return None
    model, shares, prior = _fitted(words.groupBy("word").agg(F.sum("n").cast("double").alias("n"))), None, _START
    for _ in range(most):
        # A word's rows lie together, so what it could have been is looked up once.
        asked = _with_shares(words, shares, "word").select("field", "source", "word", "n", "own").repartition(partitions(spark), "word")
        told = materialize(asked.mapInArrow(_expected(model, spark.sparkContext.broadcast(prior)), "word string, n double, field string, source string, sums array<double>"), "expected")
        sums = materialize(told.where("word is null").groupBy("field", "source").agg(F.array(*_summed("sums")).alias("sums")), "sums")
        total = np.array(sums.agg(F.array(*_summed("sums"))).first()[0])
        fresh = (total + 1000.0 * _START) / (total.sum() + 1000.0)
        model = _fitted(told.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
        moving, prior = _moved(prior, fresh, tolerance), fresh
        shares = sums
        release(told)
        if not moving:
            break
    else:
        warnings.warn(f"the shares of the chains still move after {most} rounds; the last estimates are used", stacklevel=2)
    evidence = materialize(long.mapInArrow(_evidence(model), "doc_id long, field string, source string, lost int, ratios array<double>"), "evidence")
    sizes = materialize(long.groupBy("field", "source").agg(F.count(F.lit(1)).cast("double").alias("seen")), "sizes")
    records = sizes.agg(F.sum("seen")).first()[0]
    shares = None
    for _ in range(most):
        asked = _with_shares(evidence, shares, "doc_id").select("doc_id", "field", "source", "lost", "ratios", "own")
        found = materialize(asked.mapInArrow(_posterior(spark.sparkContext.broadcast(prior)), "doc_id long, field string, source string, lost int, posterior array<double>, unharmed double"), "posterior")
        # Records without evidence are unharmed.
        hit = found.groupBy("field", "source").agg(F.array(*_summed("posterior")).alias("sums"), F.count(F.lit(1)).alias("told")).join(sizes, ["field", "source"])
        rest = F.col("seen") - F.col("told")
        sums = materialize(hit.select("field", "source", F.transform("sums", lambda x, i: F.when(i == WIDTH - 1, x + rest).otherwise(x)).alias("sums")), "sums")
        row = sums.agg(F.array(*_summed("sums"))).first()[0]
        total = np.array(row) if row[0] is not None else np.zeros(WIDTH)
        total[-1] += records - total.sum()
        fresh = (total + 100.0 * _START) / (total.sum() + 100.0)
        moving, prior = _moved(prior, fresh, tolerance), fresh
        shares = sums
        if not moving:
            break
    else:
        warnings.warn(f"the posteriors still move after {most} rounds; the last ones are used", stacklevel=2)
    return Fit(model, found)


def _reported(found: DataFrame) -> DataFrame:
    best = F.expr("array_position(slice(posterior, 1, %d), array_max(slice(posterior, 1, %d)))" % (WIDTH - 1, WIDTH - 1))
    names = F.array(*[F.lit(n) for n in NAMES])
    kept = found.where("unharmed < 0.5 or lost > 0")
    return kept.select("doc_id", "field", F.when(F.col("unharmed") < 0.5, F.element_at(names, best.cast("int"))).alias("chain"), "unharmed", "lost")


def garbled_records(docs: DataFrame, fields: tuple[str, ...] = ("text",), source: str = "source") -> DataFrame:
    """``doc_id, field, chain, unharmed, lost`` of every record and field with wrongly decoded characters.

    ``chain`` is the most probable one, null where only U+FFFD tells; ``lost``
    counts words with U+FFFD.  A null source is a source of its own; null,
    empty and plain ASCII texts are never garbled.
    """
    got = fit(docs, fields, source)
    if got is None:
        return docs.limit(0).select("doc_id", F.lit("").alias("field"), F.lit(None).cast("string").alias("chain"), F.lit(1.0).alias("unharmed"), F.lit(0).alias("lost"))
    return _reported(got.records)


def _repair(model):
    def run(batches):
        m = CharacterModel(model.value)
        chains = dict(CHAINS)
        for batch in batches:
            ids, out = [], []
            for doc, text, chain in zip(*(batch.column(i).to_pylist() for i in range(3))):
                def better(found, chain=chain):
                    parts = []
                    for w in _pieces(found.group()):
                        before = undo(w, chains[chain]) if not w.isascii() else None
                        parts.append(before if before is not None and m.log_probability(before) > m.log_probability(w) else w)
                    return "".join(parts)

                ids.append(doc)
                out.append(_TOKEN.sub(better, text) if text and chain else text)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "restored": pa.array(out, pa.string())})

    return run


def restored_texts(docs: DataFrame, field: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, chain, lost, restored``: garbled records with their text restored by the most probable chain and the fitted model, as far as it can be."""
    got = fit(docs, (field,), source)
    if got is None:
        return docs.limit(0).select("doc_id", F.lit(None).cast("string").alias("chain"), F.lit(0).alias("lost"), F.lit(None).cast("string").alias("restored"))
    found = materialize(_reported(got.records).select("doc_id", "chain", "lost"), "garbled")
    texts = docs.select("doc_id", F.col(field).alias("text")).join(found.select("doc_id", "chain").distinct(), "doc_id")
    fixed = texts.select("doc_id", "text", "chain").mapInArrow(_repair(got.model), "doc_id long, restored string")
    return found.join(fixed, "doc_id")


def harm(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text after the chain, as a wrong decoder leaves it, or None where it can't come through or isn't changed."""
    out = text
    for written, read in chain:
        chars, back = _high_half(read), {c: b for b, c in _high_half(written).items()} if written != "utf-8" else {}
        done = []
        for c in out:
            raw = [ord(c)] if c < "\x80" else list(c.encode("utf-8")) if written == "utf-8" else [back[c]] if c in back else None
            if raw is None or any(b >= 0x80 and b not in chars for b in raw):
                return None
            done += [chr(b) if b < 0x80 else chars[b] for b in raw]
        out = "".join(done)
    return out if out != text else None


def _harmed(batches):
    for batch in batches:
        ids, texts, sources, chains, whole = [], [], [], [], []
        for doc, text, source, pick in zip(*(batch.column(i).to_pylist() for i in range(4))):
            name, chain = CHAINS[pick % len(CHAINS)]
            bad = harm(text, chain) if text and pick >= 0 and not text.isascii() else None
            ids.append(doc)
            sources.append(source)
            texts.append(bad or text)
            chains.append(name if bad else None)
            whole.append(text if bad else None)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "source": pa.array(sources, pa.string()), "planted": pa.array(chains, pa.string()), "whole": pa.array(whole, pa.string())})


def restoration(docs: DataFrame, every: int = 50) -> DataFrame:
    """``chain, records, found, restored``: how many records that were harmed on purpose are found, and restored to the letter.

    Records whose identifier is divisible by ``every`` and that aren't garbled
    already are sent through a chain chosen by their identifier and stand among
    all others; a record the chain can't take is left out.
    """
    clean = docs.join(garbled_records(docs).select("doc_id").distinct().withColumn("bad", F.lit(True)), "doc_id", "left")
    pick = F.when(F.col("bad").isNull() & (F.col("doc_id") % every == 0), F.pmod(F.xxhash64("doc_id"), F.lit(len(CHAINS)))).otherwise(-1).cast("int")
    mixed = materialize(clean.select("doc_id", "text", "source", pick.alias("pick")).mapInArrow(_harmed, "doc_id long, text string, source string, planted string, whole string"), "mixed")
    asked = mixed.where("planted is not null").select("doc_id", "planted", "whole")
    got = asked.join(restored_texts(mixed).select("doc_id", "restored"), "doc_id", "left")
    return got.groupBy(F.col("planted").alias("chain")).agg(F.count(F.lit(1)).alias("records"), F.count("restored").alias("found"), F.count_if(F.col("restored") == F.col("whole")).alias("restored"))
