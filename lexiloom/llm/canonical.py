"""Free-typed values mapped to a canonical list: token repair by edit distance, then soft TF-IDF over whole entries.

1. Values are reduced to distinct bare forms: no accents, case, marks or labels in brackets; tokens in order. A form that is an entry's is that entry.
2. Distinct tokens are joined to the list's vocabulary: the entries' words, their plurals, and whole entries written together. Two words within the
   edits that their length allows have a common rest once as many letters are dropped from the beginning of each, so both are
   filed under what is left of their first letters (``variants``), equal rests are an equi-join, and the pairs that meet are verified by the distance with
   transpositions. How many first letters count depends on the list: as many as leave at most ``UNDER_ONE`` forms under one beginning.
3. Each content word of a form must be matched by one of the entry and the other way round, so the entries that hold what the form's rarest
   token stands for are all that can be its entry. Of each such pair of form and entry the words are matched at the least cost (``assigned``), and the entries are
   ranked by soft TF-IDF (both sides' word weights from the list, similarities from the repairs), then by the words left over, edits and id.
4. The forms' entries go back to the rows. A form without an entry gets -1: it differs from each by a whole word.

The list and its tables are joined like any other, so Spark broadcasts them where their size in the shared folder is small and shuffles them where not; tokens and
forms are distinct before any join, so a value that a third of all rows hold is one row in steps 2 and 3, and step 4 is a join that Spark splits where a
form is hot. Pairs are ranked row by row and the best is an aggregate: nothing gathers the entries of a form.

Null and blank elements and elements that are an entry letter for letter aren't reported; elements are numbered with them. An
element without any letter or digit is reported with -1. Of entries with one bare form the smallest id holds. Null entries and ids are left out.
Repeated rows give repeated results, an empty list gives -1 everywhere. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.sources.tables import kept

# Words that an entry may gain or lose.
SMALL = ["a", "an", "the", "some", "any", "to", "of", "or", "and", "in", "on", "for", "with", "is", "be", "it", "its", "my", "your", "this", "that", "one", "very", "maybe", "perhaps", "probably"]
#: First letters that count at least, and the most forms under one beginning for which no more letters count.
FIRST, UNDER_ONE = 7, 500
#: Most rows of the filed forms that are broadcast (about 100 bytes each); beyond it they are joined by a shuffle.
BROADCAST = 400_000

_LABEL = re.compile(r"[(\[{<][^()\[\]{}<>]*[)\]}>]")
_PLURAL = re.compile(r"\((?:s|es|ies|pl|plural)\)", re.I)
_TOKEN = re.compile(r"[^\W_]+")


def bare_tokens(value: str) -> list[str]:
    """The tokens of a value without accents, case, marks and labels. What consists of labels only keeps them."""
    text = unicodedata.normalize("NFKD", value.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c)).replace("'", "").replace("’", "")
    text = _PLURAL.sub("", text)
    shorter = _LABEL.sub(" ", text)
    return _TOKEN.findall(shorter) or _TOKEN.findall(text)


def plurals(word: str) -> list[str]:
    """How the word may stand in another number."""
    out = [word + "s", word + "es"]
    if word.endswith("y"):
        out.append(word[:-1] + "ies")
    if word.endswith("f"):
        out.append(word[:-1] + "ves")
    if word.endswith("fe"):
        out.append(word[:-2] + "ves")
    if word.endswith("man"):
        out.append(word[:-3] + "men")
    if word.endswith("us"):
        out.append(word[:-2] + "i")
    if word.endswith("s") and len(word) > 3:
        out.append(word[:-1])
    return out


def edits_allowed(length: int) -> int:
    return 0 if length <= 2 else 1 if length <= 4 else 2


def variants(word: str, first: int = FIRST) -> set[str]:
    """The first letters of a word with as many left out as its length allows edits.

    Of two words within k edits, each can drop up to k letters so that the rests are equal, and the same holds for their first ``first`` letters: where
    one of these beginnings has lost more than the other, the other's rest is cut by as many at its end, which is k in all at most.
    """
    start, most = word[:first], edits_allowed(len(word))
    return {"".join(c for i, c in enumerate(start) if i not in gone) for k in range(min(most, len(start)) + 1) for gone in combinations(range(len(start)), k)}


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, drop, replace, swap neighbours) from a to b; most + 1 if there are more."""
    far = most + 1
    if abs(len(a) - len(b)) > most:
        return far
    # only cells beside the diagonal can hold ``most`` or less
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                new[0] = i
                continue
            d = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before.get(j - 2, far) + 1)
            new[j] = d
        if min(new.values(), default=far) > most:
            return far
        before, row = row, new
    return min(row.get(len(b), far), far)


def vocabulary(i: int, tokens: list[str]) -> list[tuple[str, str, str, float]]:
    """The forms of an entry's words and of the whole entry: the form, its kind, the word or the entry's id, what the form costs."""
    out = []
    content = [t for t in tokens if t not in SMALL] or tokens
    for t in tokens:
        out.append((t, "word", t, 0.0))
        if t in content:
            out += [(p, "word", t, 0.05) for p in plurals(t)]
    if len(tokens) > 1:
        out += [("".join(tokens), "entry", str(i), 0.0), ("".join(content), "entry", str(i), 0.0), ("".join(tokens) + "s", "entry", str(i), 0.05)]
    return out


class Listed:
    """A canonical list as tables: ``entries`` (gloss_id, form, tokens, weights), ``postings`` (word, the entry that holds it), ``forms`` (form, kind, target, cost, df) and ``filed`` (part, form)."""

    def __init__(self, entries: DataFrame):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens = [bare_tokens(g) for g in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(t) for t in tokens], pa.string())], ["gloss_id", "form"])

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = [pa.string(), pa.string(), pa.string(), pa.float64()]
            for batch in batches:
                rows = [r for i, f in zip(*(c.to_pylist() for c in batch.columns)) for r in vocabulary(i, f.split())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["form", "kind", "target", "cost"])

        one = entries.select("gloss_id", "gloss").mapInArrow(cut, "gloss_id bigint, form string").where("form <> ''").groupBy("form").agg(F.min("gloss_id").alias("gloss_id"))
        one = kept(one.select("gloss_id", "form"), "listed")
        self.n = one.count()
        place = one.select("gloss_id", "form", F.posexplode(F.split("form", " ")).alias("pos", "word"))
        df = kept(place.select("gloss_id", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df")), "df")
        weighted = place.join(df, "word").groupBy("gloss_id", "form").agg(F.array_sort(F.collect_list(F.struct("pos", "word", F.log1p(F.lit(float(self.n)) / F.col("df")).alias("weight")))).alias("w"))
        self.entries = kept(weighted.select("gloss_id", "form", F.transform("w", lambda x: x["word"]).alias("tokens"), F.transform("w", lambda x: x["weight"]).alias("weights")), "entries")
        self.postings = kept(self.entries.select(F.explode(F.array_distinct("tokens")).alias("word"), "gloss_id", "tokens", "weights"), "postings")
        forms = one.mapInArrow(spell, "form string, kind string, target string, cost double").groupBy("form", "kind", "target").agg(F.min("cost").alias("cost"))
        self.forms = kept(forms.join(df.withColumnRenamed("word", "target"), "target", "left").select("form", "kind", "target", "cost", F.coalesce("df", F.lit(1)).alias("df")), "forms")
        self.first = self._first()
        first = self.first

        @F.pandas_udf("array<string>")
        def parts(x: pd.Series) -> pd.Series:
            return x.map(lambda w: sorted(variants(w, first)))

        filed = kept(self.forms.select("form").distinct().select("form", F.explode(parts("form")).alias("part")), "filed")
        self.filed = F.broadcast(filed) if filed.count() <= BROADCAST else filed

    def _first(self) -> int:
        """The number of first letters that leave at most ``UNDER_ONE`` forms under one beginning, or that all forms have."""
        forms = self.forms.select("form").distinct()
        first = FIRST
        while True:
            most = forms.where(F.length("form") > first).groupBy(F.substring("form", 1, first)).count().agg(F.max("count")).first()[0] or 0
            if most <= UNDER_ONE:
                return first
            first += FIRST


def repairs(tokens: DataFrame, listed: Listed) -> DataFrame:
    """``token, kind, target, edits, cost, df``: each distinct token with the words or whole entries it may stand for."""
    first = listed.first

    @F.pandas_udf("array<string>")
    def parts(x: pd.Series) -> pd.Series:
        return x.map(lambda w: sorted(variants(w, first)))

    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([distance(x, y) for x, y in zip(a, b)], dtype="int32")

    edits = edits.asNondeterministic()  # else the filter on it is moved below distinct and it runs for every common variant of a pair
    # few bytes hold many tokens, each with some dozen variants: a fixed number of tasks, which isn't reduced by size
    tasks = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens.sparkSession.sparkContext.defaultParallelism)
    left = tokens.repartition(tasks).select("token", F.explode(parts("token")).alias("part"))
    met = left.join(listed.filed, "part").where(F.abs(F.length("token") - F.length("form")) <= 2).groupBy("token", "form").agg(F.count(F.lit(1)).alias("times"))
    # Without swaps the distance is twice as long at most, and the same up to one edit. It depends on ``times`` so that it isn't measured before pairs are distinct.
    met = met.withColumn("plain", F.when(F.col("times") > 0, F.levenshtein("token", "form", 4)).otherwise(-1)).where("plain >= 0")
    size = F.least(F.length("token"), F.length("form"))
    allowed = F.when(size <= 2, 0).when(size <= 4, 1).otherwise(2)
    near = met.withColumn("edits", F.when((F.col("plain") <= 1) | (allowed == 0), F.col("plain")).otherwise(edits("token", "form")))
    return near.where(F.col("edits") <= allowed).join(listed.forms, "form").select("token", "kind", "target", "edits", "cost", "df")


def assigned(ways: list[dict[int, float]]) -> dict[int, int] | None:
    """A partner for each row at the least cost in all, as row by partner; None if they can't all have one. ``ways`` has the possible partners of each row with their costs."""
    owner: dict[int, int] = {}
    for row, own in enumerate(ways):
        # the cheapest chain of moves that frees a partner for this row
        dist: dict[int, tuple[float, int | None]] = {c: (x, None) for c, x in own.items()}
        queue = list(dist)
        while queue:
            c = queue.pop(0)
            if c in owner:
                base = dist[c][0] - ways[owner[c]][c]
                for d, x in ways[owner[c]].items():
                    if d not in dist or base + x < dist[d][0] - 1e-9:
                        dist[d] = (base + x, c)
                        queue.append(d)
        free = [(x, c) for c, (x, _) in dist.items() if c not in owner]
        if not free:
            return None
        c: int | None = min(free)[1]
        while c is not None:
            before = dist[c][1]
            owner[c] = row if before is None else owner[before]
            c = before
    return owner


def likeness(tokens: list[str], meaning: dict[str, dict[str, float]], own: dict[str, float], entry: list[str], weights: list[float]) -> tuple[float, float, float] | None:
    """Minus the soft TF-IDF of a form and an entry, the small words that differ, and the edits; None if a content word of either has no partner.

    ``meaning`` has the words that each token may stand for with their costs, ``own`` the tokens' weights.
    """
    content = {t for t in tokens if t not in SMALL} or set(tokens)
    ours = [(w, x) for w, x in zip(entry, weights) if w not in SMALL] or list(zip(entry, weights))
    far = 1000.0  # more than all costs: as many content words as possible get a partner
    owner = assigned([{k: meaning[t][w] - (far if t in content else 0.0) for k, t in enumerate(tokens) if w in meaning[t]} for w, _ in ours])
    if owner is None or any(t in content and k not in owner for k, t in enumerate(tokens)):
        return None
    score = edits = 0.0
    for k, row in owner.items():
        w, x = ours[row]
        cost = meaning[tokens[k]][w]
        edits += cost
        score += x * own[tokens[k]] * (1 - cost / (len(w) + 1))
    norm = math.sqrt(sum(x * x for _, x in ours)) * math.sqrt(sum(own[tokens[k]] ** 2 for k in owner))
    small = sum(w not in tokens for w in entry if w in SMALL) + sum(k not in owner and t not in entry for k, t in enumerate(tokens))
    return -round(score / norm, 9), float(small), round(edits, 9)


def mapped(forms: DataFrame, entries: DataFrame) -> DataFrame:
    """``form, gloss_id`` for distinct bare forms (tokens with spaces between) that have an entry."""
    listed = Listed(entries)
    unknown = math.log1p(listed.n)
    exact = forms.join(listed.entries.select("form", "gloss_id"), "form")
    rest = forms.join(listed.entries.select("form"), "form", "left_anti")
    tokens, small = F.split("form", " "), F.array(*map(F.lit, SMALL))
    joined, bare = F.array_join(tokens, ""), F.array_join(F.filter(tokens, lambda t: ~F.array_contains(small, t)), "")
    split = rest.select("form", (F.size(tokens) > 1).alias("several"), joined.alias("joined"), bare.alias("bare"), F.explode(F.array_union(tokens, F.array(joined, bare))).alias("token")).where("token <> ''")
    split = split.select("form", "several", "token", (F.col("token") == F.col("joined")).alias("is_joined"), ((F.col("token") == F.col("joined")) | (F.col("token") == F.col("bare"))).alias("whole"))
    fixed = kept(repairs(split.select("token").distinct(), listed), "repairs")
    meant = kept(split.join(fixed, "token").withColumn("cost", F.col("edits") + F.col("cost")), "meant")

    # whole entries written together, and words cut in two
    likely = -F.round(1 - F.col("cost") / (F.length("token") + 1), 9)
    ranked = [likely.alias("score"), F.lit(0.0).alias("small"), F.col("cost").alias("edits")]
    together = meant.where("whole and kind = 'entry'").select("form", *ranked, F.col("target").cast("bigint").alias("gloss_id"))
    single = listed.entries.where(F.size("tokens") == 1).select(F.col("form").alias("target"), "gloss_id")
    apart = meant.where("is_joined and several and kind = 'word' and edits <= 1").join(single, "target").select("form", *ranked, "gloss_id")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each form with the words that its rarest content token may stand for, and those of the next."""
        for batch in batches:
            rows, words, others = [], [], []
            for k, (form, tokens, targets, dfs) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)))):
                of: dict[str, dict[str, int]] = defaultdict(dict)
                for t, w, n in zip(tokens, targets, dfs):
                    of[t][w] = n
                every = form.split(" ")
                content = {t for t in every if t not in SMALL} or set(every)
                if all(t in of for t in content):
                    by_df = sorted(content, key=lambda t: (sum(of[t].values()), t))
                    first, second = by_df[0], by_df[min(1, len(by_df) - 1)]
                    words += of[first]
                    rows += [k] * len(of[first])
                    others += [list(of[second])] * len(of[first])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(5)), pa.array(words, pa.string()), pa.array(others, pa.list_(pa.string()))], ["form", "token", "target", "cost", "df", "word", "other"])

    n = float(listed.n)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k, (form, tokens, targets, costs, dfs, entry, weights) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(7)))):
                every = form.split(" ")
                of: dict[str, dict[str, float]] = {t: {} for t in every}
                own = dict.fromkeys(every, unknown)
                for t, w, cost, df in zip(tokens, targets, costs, dfs):
                    if t in of:
                        of[t][w] = min(cost, of[t].get(w, cost))
                        if t == w:
                            of[t][w] = 0.0
                            own[t] = math.log1p(n / df)
                if (found := likeness(every, of, own, entry, weights)) is not None:
                    rows.append(k)
                    out.append(found)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *[pa.array([o[i] for o in out], pa.float64()) for i in range(3)], batch.column(7).take(at)], ["form", "score", "small", "edits", "gloss_id"])

    of_form = meant.where("kind = 'word'").groupBy("form").agg(F.collect_list(F.struct("token", "target", "cost", F.col("df").cast("bigint").alias("df"))).alias("m"))
    meaning = ["m.token", "m.target", "m.cost", "m.df"]
    sought = of_form.select("form", *meaning).mapInArrow(seek, "form string, token array<string>, target array<string>, cost array<double>, df array<bigint>, word string, other array<string>")
    size = F.size(F.split("form", " "))
    n_content = lambda c: F.size(F.filter(c, lambda t: ~F.array_contains(small, t)))
    # neither side can have more content words than the other has words
    met = sought.join(listed.postings, "word").where(F.arrays_overlap("other", "tokens") & (n_content(F.col("tokens")) <= size) & (n_content(F.split("form", " ")) <= F.size("tokens")))
    by_words = met.select("form", "token", "target", "cost", "df", "tokens", "weights", "gloss_id").mapInArrow(rank, "form string, score double, small double, edits double, gloss_id bigint")
    best = by_words.unionByName(together).unionByName(apart).groupBy("form").agg(F.min(F.struct("score", "small", "edits", "gloss_id"))["gloss_id"].alias("gloss_id"))
    return exact.unionByName(best)


def assign(values: DataFrame, entries: DataFrame, value: str = "value") -> DataFrame:
    """``values`` with ``gloss_id``, without the rows that aren't reported; see the module."""
    entries = entries.where("gloss_id is not null and gloss is not null").select(F.col("gloss_id").cast("bigint"), "gloss")

    @F.pandas_udf("string")
    def bare(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else " ".join(bare_tokens(v)))

    some = values.where(F.col(value).isNotNull() & F.col(value).rlike(r"(?U)[^\s​]"))
    distinct = some.select(F.col(value).alias("v")).distinct().join(entries.select(F.col("gloss").alias("v")), "v", "left_anti")
    formed = kept(distinct.select("v", bare("v").alias("form")), "formed")
    best = kept(mapped(formed.where("form <> ''").select("form").distinct(), entries), "mapped")
    by_value = formed.join(best, "form", "left").select("v", F.coalesce("gloss_id", F.lit(-1)).cast("bigint").alias("gloss_id"))
    return some.join(by_value, some[value] == by_value["v"]).drop("v")


def guesses(submissions: DataFrame) -> DataFrame:
    """``field, row_key, item_no, value`` of candidates that are a JSON list of nothing but strings."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            out: list[list] = [[], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    v = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                if isinstance(v, list) and all(isinstance(x, str) for x in v):
                    for k, x in enumerate(v, 1):
                        for column, y in zip(out, (key, k, x.encode("utf-8", "replace").decode("utf-8"))):
                            column.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.string()))], ["row_key", "item_no", "value"])

    rows = submissions.select(F.col("ord").cast("bigint"), F.col("candidates").cast("string")).where("candidates is not null")
    return rows.mapInArrow(read, "row_key bigint, item_no int, value string").select(F.lit("candidates").alias("field"), "row_key", "item_no", "value")


def answers(curation: DataFrame) -> DataFrame:
    """``field, row_key, item_no, value`` of the elements of answers."""
    one = curation.select(F.col("curation_id").cast("bigint").alias("row_key"), F.posexplode("answers").alias("pos", "value"))
    return one.select(F.lit("answers").alias("field"), "row_key", (F.col("pos") + 1).cast("int").alias("item_no"), "value")


def found(submissions: DataFrame, curation: DataFrame, entries: DataFrame) -> DataFrame:
    """``field, row_key, item_no, gloss_id`` of every typed value."""
    values = guesses(submissions).unionByName(answers(curation))
    return assign(values, entries).select("field", "row_key", "item_no", "gloss_id")
