"""Main content of web pages by template deduction (problem 2).

A line is a path of words (numbers and the site's name masked), so tokens are
the nodes of these paths, told apart by the words before them; what stands in
every page at the same node is the template's, what differs is a slot.  Over the
pages of one host every token has an occurrence vector, how often it occurs in
each page, kept as a fingerprint; tokens of equal vectors form an equivalence
class.  A class of tokens that end no sentence is valid, and part of the
template, when it has three words and four occurrences.  Menus,
labels before a slot, counters and footers appear as such classes whole.

What no class decides is nested: a recurring line whose occurrences mostly
stand between lines of the template joins it, and so on for a few rounds, which
tells notices that are sentences from sentences of an article.  What is left
between is the slot that holds the article.  Tokens of small hosts are judged by
the pooled evidence of all hosts, since a single page has no vector to compare.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekline.plans.lineage import materialize
from seekline.sources.tables import spread

#: Words of a line's path that are tokens; the rest of a longer line is one token more.
PATH = 8
#: Least words of a valid class, and least occurrences of any token that is judged.
CLASS_WORDS, SUPPORT = 3, 4
#: Most tokens that are sent to every task (16 bytes each); beyond it they are joined.
MAX_SENT = 2_000_000
_NUMBER = re.compile(r"\d[\d.,:  ]*\d|\d")
_SPLIT = re.compile(r"\s*[|·•›»/]\s*|\s{2,}")
_END = re.compile(r"[.!?;…][\"'»”’)\]]*$")


def _host(url: str | None) -> tuple[str, str]:
    """Host and the part of it that names the site."""
    m = re.match(r"(?i)https?://([^/?#]+)", url or "")
    host = m.group(1).lower() if m else ""
    parts = host.split(".")
    return host, parts[-2] if len(parts) > 1 else host


def _hash(kind: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(kind + text) >> 1


def _read_lines(batches):
    """One row a page: host, and for its lines that aren't blank number, tokens, sentence ends and link labels."""
    known: dict[str, int] = {}

    def node(text):
        h = known.get(text)
        if h is None:
            if len(known) > 200_000:
                known.clear()
            h = known[text] = _hash("P", text)
        return h

    for batch in batches:
        out = {k: [] for k in ("doc_id", "host", "line_no", "full", "first", "path", "ends", "words", "label", "label_at")}
        for doc, url, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not content or doc is None:
                continue
            host, site = _host(url)
            named = re.compile(re.escape(site), re.I) if site else None
            no, full, first, path, ends, words, label, label_at = ([] for _ in range(8))
            for n, line in enumerate(content.split("\n"), 1):
                line = line.strip()
                if not line:
                    continue
                mask = _NUMBER.sub("#", line)
                if named:
                    mask = named.sub("@", mask)
                ended = bool(_END.search(line))
                w = mask.split()
                full.append(_hash("F", mask))
                if len(w) > 1 and not (ended and len(w) > 16):
                    first += [_hash("1", w[0]) if w[0][-1] == ":" else 0, _hash("2", " ".join(w[:2])) if len(w) > 2 else 0, _hash("3", " ".join(w[:3])) if len(w) > 3 else 0]
                else:
                    first += [0, 0, 0]
                text = ""
                for k in range(min(PATH, len(w))):
                    text = f"{text} {w[k]}"
                    path.append(node(text))
                path += [0] * (PATH - len(w))
                if not ended:
                    parts = _SPLIT.split(mask)
                    if len(parts) >= 3:
                        for x in parts:
                            label.append(_hash("L", x))
                            label_at.append(len(no))
                no.append(n)
                ends.append(ended)
                words.append(min(len(w), 99))
            if no:
                for k, v in zip(out, (doc, host, no, full, first, path, ends, words, label, label_at)):
                    out[k].append(v)
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int16()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


PAGES = "doc_id long, host string, line_no array<int>, full array<long>, first array<long>, path array<long>, ends array<boolean>, words array<short>, label array<long>, label_at array<int>"


def _flat(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(x):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _marks(places, lengths: np.ndarray) -> np.ndarray:
    """A flag for each entry of lists of these lengths, set at the places of each list."""
    out = np.zeros(int(lengths.sum()), bool)
    out[_flat(places).astype(np.int64) + np.repeat(np.cumsum(lengths) - lengths, np.diff(places.offsets.to_numpy()))] = True
    return out


class _Lines:
    """The lines of a batch of pages laid end to end, and which of them belong to the template so far."""

    def __init__(self, batch, template: np.ndarray | None):
        at = {n: i for i, n in enumerate(batch.schema.names)}
        column = lambda n: batch.column(at[n])
        self.doc = column("doc_id").to_numpy(zero_copy_only=False)
        self.lengths = np.diff(column("full").offsets.to_numpy())
        self.page = np.repeat(np.arange(len(self.doc)), self.lengths)
        self.full, self.first = _flat(column("full")), _flat(column("first")).reshape(-1, 3)
        self.path = _flat(column("path")).reshape(-1, PATH)
        self.ends, self.words, self.no = _flat(column("ends")), _flat(column("words")), _flat(column("line_no"))
        start = np.cumsum(self.lengths) - self.lengths
        counts = np.diff(column("label").offsets.to_numpy())
        self.label, self.label_line = _flat(column("label")), _flat(column("label_at")) + np.repeat(start, counts)
        if template is not None:
            self.hit = _isin(self.full, template) | _isin(self.first.ravel(), template).reshape(-1, 3).any(axis=1) | _isin(self.path.ravel(), template).reshape(-1, PATH).any(axis=1)
        else:
            self.hit = _marks(column("hits"), self.lengths)
        n = len(self.full)
        self.opens = np.zeros(n, bool)
        self.closes = np.zeros(n, bool)
        self.opens[start[self.lengths > 0]] = True
        self.closes[(start + self.lengths - 1)[self.lengths > 0]] = True

    def beside(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether the line before, and the line after, is of the template; a page's edge counts as such where the page has template lines."""
        has = np.bincount(self.page, weights=self.hit, minlength=len(self.doc))[self.page] - self.hit > 0
        before, after = np.roll(self.hit, 1), np.roll(self.hit, -1)
        return np.where(self.opens, has, before), np.where(self.closes, has, after)


def _nesting(template, known):
    """Occurrences of tokens, and how many stand beside the template, pre-aggregated."""

    def run(batches):
        t = template.value if template is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _Lines(batch, t)
            before, after = x.beside()
            token = np.concatenate([x.full, x.first.ravel()])
            fore = np.concatenate([before, np.repeat(before, 3)])
            next_ = np.concatenate([after, np.repeat(after, 3)])
            ended = np.concatenate([x.ends, np.repeat(x.ends, 3)])
            kind = np.concatenate([np.zeros(len(x.full), np.int64), np.tile([1, 2, 3], len(x.full))])
            words = np.concatenate([x.words, np.repeat(x.words, 3)])
            keep = token != 0
            if known is not None:
                keep &= _isin(token, known.value)
            token, fore, next_, ended, kind, words = (v[keep] for v in (token, fore, next_, ended, kind, words))
            ids, one, where = np.unique(token, return_index=True, return_inverse=True)
            n = np.bincount(where, minlength=len(ids))
            count = lambda w: pa.array(np.bincount(where, weights=w, minlength=len(ids)).astype(np.int64))
            yield pa.RecordBatch.from_pydict({"token": pa.array(ids, pa.int64()), "kind": pa.array(kind[one], pa.int32()), "n": pa.array(n, pa.int64()), "before": count(fore), "after": count(next_), "ended": count(ended), "words": pa.array(words[one], pa.int32())})

    return run


def _elsewhere(template, known):
    """Of each page's sentences outside the template, the tokens, the whole line and the longest other line outside the template, null where there is none."""

    def run(batches):
        t = template.value if template is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _Lines(batch, t)
            order = np.lexsort((x.full, x.page))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (x.full[order[1:]] == x.full[order[:-1]]) & (x.page[order[1:]] == x.page[order[:-1]])
            size = np.where(x.hit | again, 0, x.words)
            order = np.lexsort((x.full, -size, x.page))
            start = (np.cumsum(x.lengths) - x.lengths)[x.page]
            one, two = order[start], order[np.minimum(start + 1, len(order) - 1)]
            other = np.where(x.full[one] != x.full, one, two)
            none = (size[other] == 0) | (x.page[other] != x.page)
            asked = x.ends & ~x.hit
            token, line = np.concatenate([x.full[asked], x.first[asked, 2]]), np.tile(np.flatnonzero(asked), 2)
            keep = token != 0
            if known is not None:
                keep &= _isin(token, known.value)
            token, line = token[keep], line[keep]
            yield pa.RecordBatch.from_pydict({"token": pa.array(token, pa.int64()), "form": pa.array(x.full[line], pa.int64()), "other": pa.array(x.full[other[line]], pa.int64(), mask=none[line])})

    return run


def _mark(template, labels, judged):
    """Lines of the template: by its tokens, as rows of known link labels, or as a short rest, too rare to be judged, that is shut in between template lines."""

    def run(batches):
        t = template.value if template is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _Lines(batch, t)
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            if len(x.label):
                known = _isin(x.label, labels.value) if labels is not None else _marks(column("known_labels"), np.diff(column("label").offsets.to_numpy()))
                unknown = np.bincount(x.label_line, weights=~known, minlength=len(x.full))
                some = np.bincount(x.label_line, minlength=len(x.full))
                x.hit = x.hit | ((some > 0) & (unknown == 0))
            before, after = x.beside()
            common = _isin(x.full, judged.value) if judged is not None else _marks(column("judged_lines"), x.lengths)
            hit = x.hit | (before & after & ~x.ends & (x.words <= 6) & ~(x.opens & x.closes) & ~common)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(x.doc[x.page[hit]], pa.int64()), "line_no": pa.array(x.no[hit], pa.int32())})

    return run


def _tokens(pages: DataFrame) -> DataFrame:
    """Rows (host, doc_id, at, token, kind, full, ends): kind 0 for whole lines, 1 for first words."""
    line = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("full") - 1).alias("at"), F.col("full"), F.col("ends")))
    one = pages.select("host", "doc_id", "first", line.alias("l")).select("host", "doc_id", F.col("l.at").alias("at"), F.col("l.full").alias("full"), F.col("l.ends").alias("ends"), F.slice("first", F.col("l.at") * 3 + 1, 3).alias("first"))
    heads = F.transform(F.filter("first", lambda x: x != 0), lambda x: F.struct(x.alias("token"), F.lit(1).alias("kind")))
    both = F.concat(F.array(F.struct(F.col("full").alias("token"), F.lit(0).alias("kind"))), heads)
    return one.select("host", "doc_id", "at", "full", "ends", F.explode(both).alias("t")).select("host", "doc_id", "at", "full", "ends", "t.token", "t.kind")


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _occurrences(batches):
    """Tokens of each host with the sums of which their occurrence vectors' fingerprints are made, added up within a batch.

    A fingerprint is the sum over all occurrences of three 31-bit hashes of the
    page, so a page counts as often as it has the token.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _Lines(batch, np.zeros(0, np.int64))
        at = batch.schema.get_field_index("host")
        hosts, host = np.unique(np.array(batch.column(at).to_pylist(), dtype=object), return_inverse=True)
        host = np.array([xxhash.xxh3_64_intdigest(h) for h in hosts], np.uint64)[host][x.page]
        long = x.words > PATH
        token = np.concatenate([x.path.ravel(), x.full[long]])
        line = np.concatenate([np.repeat(np.arange(len(x.full)), PATH), np.flatnonzero(long)])
        weight = np.concatenate([np.ones(x.path.size, np.int64), x.words[long].astype(np.int64) - PATH])
        token, line, weight = token[token != 0], line[token != 0], weight[token != 0]
        key = _mixed(token, 5) ^ host[line]
        ids, one, where = np.unique(key, return_index=True, return_inverse=True)
        total = lambda w: np.bincount(where, weights=w, minlength=len(ids)).astype(np.int64)
        page = x.doc[x.page[line]]
        prints = {f"v{i}": pa.array(total((_mixed(page, i) >> np.uint64(33)).astype(np.float64))) for i in range(3)}
        yield pa.RecordBatch.from_pydict({"key": pa.array(ids.view(np.int64)), "token": pa.array(token[one], pa.int64()), "weight": pa.array(weight[one], pa.int64()), "n": pa.array(np.bincount(where, minlength=len(ids)), pa.int64()), "ended": pa.array(total(x.ends[line])), **prints})


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """``token`` of all valid classes, made of the tokens of which no line ends as a sentence.

    Pages belong to one host each, so equal vectors are of one host.
    """
    each = pages.mapInArrow(_occurrences, "key long, token long, weight long, n long, ended long, v0 long, v1 long, v2 long")
    tokens = each.groupBy("key").agg(F.first("token").alias("token"), F.max("weight").alias("weight"), *[F.sum(c).alias(c) for c in ("n", "ended", "v0", "v1", "v2")])
    # Sentences are left to the nesting, which looks at where they stand.
    tokens = materialize(tokens.where((F.col("n") >= SUPPORT) & (F.col("ended") == 0)).select("token", "weight", "n", "v0", "v1", "v2"), "tokens")
    vector = ["n", "v0", "v1", "v2"]
    valid = tokens.groupBy(*vector).agg(F.sum("weight").alias("size")).where(F.col("size") >= CLASS_WORDS)
    return tokens.join(valid.select(*vector), vector, "left_semi").select("token").distinct()


def _sent(spark, tokens: DataFrame):
    """A broadcast of sorted tokens, or None if there are more than MAX_SENT."""
    got = tokens.select("token").limit(MAX_SENT + 1).toArrow().column("token").to_numpy()
    return spark.sparkContext.broadcast(np.sort(got)) if len(got) <= MAX_SENT else None


def _with_places(pages: DataFrame, name: str, at: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pages with the places (doc_id, at, token) of the given tokens, for tokens too many to be sent."""
    found = at.select("doc_id", "at", "token").join(tokens.select("token"), "token", "left_semi").groupBy("doc_id").agg(F.collect_set("at").alias(name))
    return pages.join(found, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<int>")))


def _with_hits(pages: DataFrame, template: DataFrame) -> DataFrame:
    nodes = pages.select("doc_id", F.posexplode("path").alias("place", "token")).where("token <> 0").select("doc_id", F.floor(F.col("place") / PATH).cast("int").alias("at"), "token")
    return _with_places(pages, "hits", _tokens(pages).select("doc_id", "at", "token").unionByName(nodes), template)


def deduce_template(pages: DataFrame, rounds: int = 3, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Tokens of the template, and all that recur often enough to be judged, each as ``token``.

    ``support`` is the least number of occurrences of any token that is judged.
    """
    spark = pages.sparkSession
    on_host = _tokens(pages).groupBy("host", "token", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ends").cast("int")).alias("ended"), F.min("full").alias("least"), F.max("full").alias("most"))
    # Over all hosts: a line that stands once on each of many is judged, too.
    pooled = on_host.groupBy("token", "kind").agg(F.sum("n").alias("n"), F.max("n").alias("on_one"), F.sum("ended").alias("ended"), F.min("least").alias("least"), F.max("most").alias("most"))
    pooled = materialize(pooled.where(f"n >= {support}"), "tokens")
    # First words of one host or of many that go on in ever other ways and hardly ever end as a sentence does stand before a slot.
    slots = pooled.where(f"kind = 1 and n >= {2 * support} and ended < 0.2 * n and least <> most").select("token")
    template = materialize(equivalence_classes(pages).unionByName(slots).distinct(), "template")
    judged = pooled.select("token", "on_one")
    known = _sent(spark, judged)
    for _ in range(rounds):
        sent = _sent(spark, template)
        laid = pages if sent is not None else _with_hits(pages, template)
        stats = laid.mapInArrow(_nesting(sent, known), "token long, kind int, n long, before long, after long, ended long, words int").groupBy("token", "kind").agg(*[F.sum(c).alias(c) for c in ("n", "before", "after", "ended")], F.min("words").alias("words"))
        stats = stats.join(judged, "token")
        n, both = F.col("n"), F.col("before") + F.col("after")
        # A heading follows template lines now and then but is itself followed by the article; a notice within the article has
        # them on either side; a sentence of a copied article comes with the same other lines, one of the template with ever others.
        sentence = F.col("ended") > 0.5 * n
        short = F.col("words") < 4
        found = laid.mapInArrow(_elsewhere(sent, known), "token long, form long, other long").groupBy("token").agg(F.count(F.lit(1)).alias("places"), F.count_distinct("form").alias("forms"), F.count_distinct("other").alias("others"))
        # The first words of articles' sentences go on in ever new forms, those of a notice in a few, and a notice recurs on a host; many places tell as much.
        stats = stats.join(found, "token", "left")
        told = F.when(F.col("kind") == 0, F.col("on_one") > 1).otherwise(F.col("forms") <= 0.75 * F.col("places"))
        notice = (F.col("others") >= 0.7 * F.col("places")) & (told | (n >= 2.5 * support))
        beside = F.when(sentence, (both >= 0.7 * n) & notice).when(short, (F.col("after") >= 0.3 * n) | (F.col("before") >= 0.6 * n)).otherwise(both >= 0.5 * n)
        nested = stats.where((n >= support) & beside & F.col("kind").isin(0, 3)).select("token")
        grown = materialize(template.unionByName(nested).distinct(), "template")
        done = grown.count() == template.count()
        template = grown
        if done:
            break
    return template, judged.select("token")


def template_lines(docs: DataFrame, rounds: int = 3) -> DataFrame:
    """``doc_id, line_no`` of the lines of ``content`` that aren't part of the article; lines count from 1, blank lines are never among them.

    Rows with a null or empty content have none.  A null url counts as one
    nameless host.
    """
    spark = docs.sparkSession
    pages = materialize(spread(docs.select("doc_id", "url", "content")).mapInArrow(_read_lines, PAGES), "pages")
    template, recurring = deduce_template(pages, rounds)
    seen = pages.select("host", F.explode("label").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("host").alias("a"), F.max("host").alias("b"))
    linked = seen.where("n >= 5 and a <> b")
    sent, labels, judged = _sent(spark, template), _sent(spark, linked), _sent(spark, recurring)
    laid = pages if sent is not None else _with_hits(pages, template)
    if labels is None:
        laid = _with_places(laid, "known_labels", pages.select("doc_id", F.posexplode("label").alias("at", "token")), linked)
    if judged is None:
        laid = _with_places(laid, "judged_lines", pages.select("doc_id", F.posexplode("full").alias("at", "token")), recurring)
    return laid.mapInArrow(_mark(sent, labels, judged), "doc_id long, line_no int")


def main_content(docs: DataFrame, rounds: int = 3) -> DataFrame:
    """``doc_id, main``: each page's content without the lines of the template; null contents stay null."""
    bad = template_lines(docs, rounds).groupBy("doc_id").agg(F.collect_set("line_no").alias("bad"))  # at most a page's own lines
    lines = F.split("content", "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.when(F.coalesce(F.array_contains("bad", i + 1), F.lit(False)), None).otherwise(x)), lambda x: x.isNotNull())
    return docs.select("doc_id", "content").join(bad, "doc_id", "left").select("doc_id", F.when(F.col("content").isNotNull(), F.array_join(kept, "\n")).alias("main"))
