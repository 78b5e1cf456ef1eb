"""The driver's queries over the core operators, each over its whole tables, with flat columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import candidates as C
from lexiloom.functions import spelling as S
from lexiloom.functions import text as T
from lexiloom.functions.hashing import fnv1a
from lexiloom.operators import answers, context, matching, modifiers, rules, sampling, scoring
from lexiloom.operators.lexicon import Lexicon, normalized
from lexiloom.operators.ranking import positions
from lexiloom.plans.views import entries, lexicon, raw_entries, submissions
from lexiloom.sources.tables import kept, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def joined(c: str | Column, by: str = "|") -> Column:
    return F.array_join(c, by)


# spellings


@query
def parse_spelling(spark, sf):
    one = S.with_parsed(table(spark, sf, "set_300").where("spelling is not null").select("spelling").distinct(), "spelling").where("canonical is not null")
    marks = F.transform("chars", lambda c: joined(c["indicators"], ","))
    return one.select("spelling", "canonical", "base_key", F.size("chars").alias("n_chars"), joined(marks).alias("char_marks"), joined("word_marks", ",").alias("word_marks"))


@query
def normalize_spelling(spark, sf):
    return S.with_parsed(entries(spark, sf), "code").where("canonical is not null").select("id", F.col("canonical").alias("spelling"))


@query
def filter_valid_words(spark, sf):
    return S.with_parsed(table(spark, sf, "set_300").where("spelling is not null"), "spelling").select("row_no", F.col("canonical").isNotNull().alias("is_word"))


@query
def contiguous_spans(spark, sf):
    one = S.with_parsed(table(spark, sf, "set_300"), "spelling").where("canonical is not null")
    cut = one.select("row_no", F.explode(S.spans(F.transform("chars", lambda c: c["spelling"]))).alias("s"))
    return cut.select("row_no", F.col("s.start").alias("span_start"), F.col("s.stop").alias("span_stop"), F.col("s.key").alias("spelling"))


def _in_pairs(spark, sf) -> DataFrame:
    """Each word with the next one of its first character, by number; a frequent character's words are numbered in many partitions."""
    words = lexicon(spark, sf).words.select("id", "numeric_id", "base", F.col("base")[0].alias("first"))
    placed = positions(words, [F.col("numeric_id")], ["first"], "place")
    later = placed.select("first", (F.col("place") - 1).alias("place"), F.col("base").alias("other"))
    return placed.join(later, ["first", "place"]).select("id", "base", "other")


@query
def common_prefix_len(spark, sf):
    return _in_pairs(spark, sf).select("id", S.common_prefix(F.col("base"), F.col("other")).alias("n"))


@query
def common_suffix_len(spark, sf):
    return _in_pairs(spark, sf).select("id", S.common_suffix(F.col("base"), F.col("other")).alias("n"))


@query
def resolve_id(spark, sf):
    ids = table(spark, sf, "submission").select(F.col("targetId").alias("asked")).where("asked is not null").distinct()
    return ids.select("asked", S.resolve_id(F.col("asked")).alias("id"))


# lookups


@query
def normalize_entries(spark, sf):
    return normalized(raw_entries(spark, sf)).select("id", "numeric_id", "code", "gloss", "pos", "explanation", "is_char", "is_word", "is_indicator", "is_non_preferred", "is_dual_form", "ordinal")


@query
def display_spelling(spark, sf):
    return lexicon(spark, sf).entries.select("id", "atomic", F.col("shown").alias("spelling"), F.col("shown_base").alias("base_spelling"))


@query
def get_entry(spark, sf):
    """Every entry but the marks, asked for by its id in another writing."""
    lex = lexicon(spark, sf)
    asked = lex.raw.where("not is_indicator").select(F.concat(F.lit("b"), F.lpad(F.col("numeric_id").cast("string"), 8, "0")).alias("asked"))
    return lex.get(asked, "asked").select("asked", "id", F.col("shown").alias("spelling"), "gloss", "pos")


@query
def find_by_spelling(spark, sf):
    lex = lexicon(spark, sf)
    asked = lex.words.select(F.col("code").alias("spelling")).unionByName(table(spark, sf, "set_300").where("spelling is not null").select("spelling")).distinct()
    return lex.find_by_spelling(asked).select("asked", "id")


@query
def find_by_base_spelling(spark, sf):
    lex = lexicon(spark, sf)
    asked = lex.words.select(F.col("code").alias("spelling")).unionByName(table(spark, sf, "set_300").where("spelling is not null").select("spelling")).distinct()
    return lex.find_by_base(asked).select("asked", "id")


@query
def derivation_of(spark, sf):
    """Parts: the characters of a word with the gloss of the entry of each code, where there is one."""
    lex = lexicon(spark, sf)
    one = lex.words.select("id", F.posexplode("base").alias("part_no", "part_id"))
    known = lex.entries.select(F.col("id").alias("part_id"), F.col("code").alias("part_code"), F.col("gloss").alias("part_gloss"))
    built = one.join(known, "part_id", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part_no", F.struct(F.col("part_id").alias("id"), F.col("part_code").alias("code"), F.col("part_gloss").alias("gloss"), F.lit(None).cast("string").alias("bciAvId")).alias("part")))).alias("p"))
    with_parts = lex.raw.join(built.select("id", F.transform("p", lambda x: x["part"]).alias("derivation_parts")), "id")
    return Lexicon(with_parts, lex.indicators).derivation().select("id", "part_no", "part_id", "part_code", "part_gloss")


@query
def sealed_targets(spark, sf):
    return lexicon(spark, sf).sealed()


@query
def indicators_of(spark, sf):
    return lexicon(spark, sf).marks_of()


# matches


@query
def subwords(spark, sf):
    return matching.subwords(lexicon(spark, sf)).select("target_id", F.col("start").alias("span_start"), F.col("stop").alias("span_stop"), "key", "helper_id")


@query
def subword_counts(spark, sf):
    return matching.subword_counts(lexicon(spark, sf))


@query
def siblings(spark, sf):
    return matching.siblings(lexicon(spark, sf)).select("target_id", "helper_id")


@query
def shared_start(spark, sf):
    return matching.shared_start(lexicon(spark, sf)).select("target_id", "helper_id", "shared_len", "total")


@query
def shared_end(spark, sf):
    return matching.shared_end(lexicon(spark, sf)).select("target_id", "helper_id", "shared_len", "total")


@query
def neighbours(spark, sf):
    return matching.counts(lexicon(spark, sf)).select("target_id", "side", "n", "shared", F.col("numbers").alias("checksum"))


@query
def neighbours_capped(spark, sf):
    return matching.first_neighbours(lexicon(spark, sf)).select("target_id", "side", "rank", "helper_id", "shared_len")


@query
def neighbours_omitted(spark, sf):
    return matching.omitted(matching.counts(lexicon(spark, sf)))


@query
def legend(spark, sf):
    lex = lexicon(spark, sf)
    return matching.legend(lex, matching.first_neighbours(lex)).select("target_id", "spelling", "base_spelling", "length", "helper_id")


# modifiers


def _with_modifiers(spark, sf) -> DataFrame:
    lex = lexicon(spark, sf)
    return modifiers.with_modifiers(lex.words.select("id", "base"), lex.modifiers, lex.exceptions)


@query
def modifier_matches(spark, sf):
    return _with_modifiers(spark, sf).select("id", F.explode("found").alias("m")).select("id", F.col("m.start").alias("span_start"), F.col("m.stop").alias("span_stop"), F.col("m.spelling").alias("spelling"))


@query
def modifier_exceptions(spark, sf):
    """Words with the sequence of an exception: those of the lexicon, and each of them once more with what cancels it at its end."""
    lex = lexicon(spark, sf)
    (code, following), *_ = lex.exceptions
    some = lex.words.where(F.array_contains("base", code)).select("id", "base")
    longer = some.select(F.concat("id", F.lit("+")).alias("id"), F.concat("base", F.array(F.lit(code), F.lit(following))).alias("base"))
    words = modifiers.with_modifiers(some.unionByName(longer), lex.modifiers, lex.exceptions)
    return words.select("id", F.size(F.filter("base", lambda c: c == code)).alias("times"), F.size(F.filter("found", lambda m: m["spelling"] == code)).alias("counted"))


@query
def leading_modifier_run(spark, sf):
    out = _with_modifiers(spark, sf).where(F.size("run") > 0)
    return out.select("id", joined(F.transform("run", lambda m: m["spelling"]), ",").alias("run"), "rest", (F.col("rest") == F.size("base")).alias("consumed_all"))


@query
def full_modifier(spark, sf):
    return _with_modifiers(spark, sf).where("full is not null").select("id", "full")


@query
def modifier_glosses(spark, sf):
    lex = lexicon(spark, sf)
    return modifiers.reference_glosses([{"spelling": m["spelling"]} for m in lex.modifiers], lex)


# glosses and answers


def _glosses(spark, sf) -> DataFrame:
    lex = entries(spark, sf).select("id", "pos", "gloss")
    typed = table(spark, sf, "answer_alias_curation").select(F.concat(F.lit("C"), F.col("curation_id").cast("string")).alias("id"), F.lit("noun").alias("pos"), joined("answers", "; ").alias("gloss"))
    return lex.unionByName(typed).where("gloss is not null")


@query
def clean_text(spark, sf):
    return _glosses(spark, sf).select("id", T.clean_text(F.col("gloss")).alias("text"))


@query
def split_gloss(spark, sf):
    return _glosses(spark, sf).select("id", joined(T.split_top_level(F.col("gloss"))).alias("parts"), F.size(T.split_top_level(F.col("gloss"))).alias("n"))


@query
def base_answers(spark, sf):
    return _glosses(spark, sf).select("id", joined(T.base_answers(F.col("gloss"))).alias("forms"))


@query
def inner_tags(spark, sf):
    return _glosses(spark, sf).select("id", joined(T.inner_tags(F.col("gloss"))).alias("tags"))


@query
def bare_head(spark, sf):
    return _glosses(spark, sf).select("id", T.bare_head(F.col("gloss")).alias("head"))


@query
def stray_separator(spark, sf):
    return _glosses(spark, sf).select("id", T.stray_separator(F.col("gloss")).alias("stray"))


@query
def inflection(spark, sf):
    """Each tag of each alternative with the plural that it stands for."""
    one = _glosses(spark, sf).select("id", F.explode(T.base_answers(F.col("gloss"))).alias("form")).distinct()
    tags = one.select("id", "form", F.explode(T.inner_tags(F.col("form"))).alias("tag"))
    return tags.select("id", "form", "tag", T.plural_of(T.bare_head(F.col("form")), F.col("tag")).alias("plural")).distinct()


@query
def needs_curation(spark, sf):
    return _glosses(spark, sf).select("id", T.needs_curation(T.base_answers(F.col("gloss"))).alias("needed"))


@query
def dialect_variants(spark, sf):
    return _glosses(spark, sf).select("id", T.dialect_variant(F.col("gloss")).alias("variant")).where("variant is not null")


def _key(spark, sf) -> DataFrame:
    """The lexicon's answers; where a target id is also a reviewed one's, the review counts."""
    return answers.answer_key(entries(spark, sf), answers.latest_reviews(table(spark, sf, "answer_alias_curation")))


@query
def answer_key(spark, sf):
    return _key(spark, sf).select("target_id", "pos", joined("answers").alias("answers"), "source")


@query
def answer_aliases(spark, sf):
    one = _key(spark, sf).select("target_id", F.explode("added").alias("a"))
    return one.select("target_id", F.col("a.form").alias("form"), F.col("a.reason").alias("reason"))


@query
def alias_log(spark, sf):
    return answers.alias_log(_key(spark, sf)).select("target_id", "source", joined("base_forms").alias("base"), joined("answers").alias("answers"), F.size("added").alias("n_added"), "note")


@query
def alias_stats(spark, sf):
    return answers.alias_stats(_key(spark, sf))


# guesses and scores


@query
def parse_candidates(spark, sf):
    return table(spark, sf, "submission").select("ord", joined(C.candidates(F.col("candidates"))).alias("guesses"))


@query
def candidates_of(spark, sf):
    return table(spark, sf, "submission").select("ord", joined(C.candidates_of(F.col("candidates"), F.col("rawResponseText"))).alias("guesses"))


@query
def array_spans(spark, sf):
    return table(spark, sf, "submission").select("ord", F.posexplode(C.array_spans(F.col("rawResponseText"))).alias("span_no", "span"))


@query
def normalize_answers(spark, sf):
    return _glosses(spark, sf).select("id", T.normalize_answer(F.col("gloss"), F.col("pos")).alias("normal"))


@query
def dedup_last_wins(spark, sf):
    return scoring.last_rows(table(spark, sf, "submission")).select("targetId", "ord", "first_ord", "repeats")


def _scores(spark, sf) -> DataFrame:
    return scoring.scored(scoring.last_rows(submissions(spark, sf)), answers.answer_key(entries(spark, sf)))


@query
def score_rows(spark, sf):
    return _scores(spark, sf).select("target_id", "pos", "rank", "top1", "top5", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "n_candidates", joined("normalized").alias("normalized"), joined("accepted").alias("accepted"), "runner", "promptVersion")


@query
def score_summary(spark, sf):
    return scoring.summary(_scores(spark, sf)).where("pos is null").drop("pos")


@query
def score_by_pos(spark, sf):
    return scoring.summary(_scores(spark, sf)).where("pos is not null")


def _universe(spark, sf) -> DataFrame:
    return lexicon(spark, sf).words.where("not is_non_preferred").select(F.col("id").alias("target_id"))


@query
def coverage_missing(spark, sf):
    return scoring.missing(_universe(spark, sf), submissions(spark, sf))


@query
def coverage_extra(spark, sf):
    return scoring.extra(_universe(spark, sf), submissions(spark, sf))


@query
def coverage(spark, sf):
    return scoring.coverage(submissions(spark, sf), _universe(spark, sf), answers.answer_key(entries(spark, sf))).drop("official")


@query
def official_gate(spark, sf):
    return scoring.coverage(submissions(spark, sf), _universe(spark, sf), answers.answer_key(entries(spark, sf))).select("missing", "duplicates", "malformed", "official")


@query
def distinct_runners(spark, sf):
    return scoring.runners(table(spark, sf, "submission"))


# samples


def _items(spark, sf) -> DataFrame:
    words = lexicon(spark, sf).words.where("not is_non_preferred")
    return words.select(F.col("id").alias("target_id"), "numeric_id", "pos", sampling.length_bucket(F.size("chars")).alias("length"))


@query
def tie_hash(spark, sf):
    return _items(spark, sf).select("target_id", fnv1a(F.concat(F.lit("order-1|tie|"), "target_id")).alias("tie"))


@query
def char_bucket(spark, sf):
    return table(spark, sf, "set_300").select("row_no", sampling.length_bucket(F.col("charCount")).alias("bucket"))


@query
def stratified_order(spark, sf):
    return sampling.stratified_order(_items(spark, sf), ["pos", "length"]).select("target_id", "stratum", F.round("frac", 9).alias("frac"), "place")


@query
def shuffled_order(spark, sf):
    return sampling.shuffled_order(_items(spark, sf), ["pos", "length"]).select("target_id", "stratum", F.round("frac", 9).alias("frac"), "tie")


SIZES = [50, 100, 300, 1000]


def _placed(spark, sf) -> DataFrame:
    """The items in the order of the seeded shuffle, numbered."""
    ranked = sampling.shuffled_order(_items(spark, sf), ["pos", "length"])
    return positions(ranked, [F.col("frac"), F.col("tie"), F.col("target_id")], name="place")


@query
def nested_subsets(spark, sf):
    return sampling.nested_subsets(_placed(spark, sf), SIZES)


@query
def set_balance(spark, sf):
    items = _items(spark, sf)
    sets = sampling.nested_subsets(_placed(spark, sf), SIZES)
    return sampling.imbalance(items, sets.join(items.select("target_id", "pos"), "target_id"), "pos")


@query
def set_ci(spark, sf):
    sets = sampling.nested_subsets(_placed(spark, sf), SIZES)
    return sets.groupBy("size").agg(F.count(F.lit(1)).alias("n")).select("size", "n", sampling.half_width(F.col("n")).alias("half_width"))


# contexts


@query
def build_context(spark, sf):
    return context.flat(context.build(lexicon(spark, sf), legend_view=["gloss"]))  # flat reads no more of it


@query
def context_from_spelling(spark, sf):
    lex = lexicon(spark, sf)
    return context.flat(context.build(lex, matching.targets_from(table(spark, sf, "set_300").where("spelling is not null")), legend_view=["gloss"]))


@query
def exact_matches(spark, sf):
    """Known words of the spellings of the lexicon, written in another way, and of the targets that were handed in."""
    lex = lexicon(spark, sf)
    typed = lex.words.select(F.concat(F.lit(" "), F.regexp_replace(F.lower("code"), "b", "b00"), F.lit("/")).alias("spelling")).where("spelling not like '%;;%'")
    asked = typed.unionByName(table(spark, sf, "set_300").where("spelling is not null").select("spelling"))
    return context.exact_matches(lex, asked).select("target_id", "id", "spelling")


@query
def helper_views(spark, sf):
    """What is shown of each entry beside a target."""
    v = lexicon(spark, sf).views
    return v.select("id", "spelling", "base_spelling", "gloss", "pos", joined(F.transform("indicators", lambda m: F.concat_ws("~", m["spelling"], m["name"], m["scope"]))).alias("indicators"), joined("answers").alias("answers"), "explanation")


@query
def answer_keys(spark, sf):
    """The words' spellings, parts of speech, answers and explanations."""
    return lexicon(spark, sf).answer_keys().select("id", "spelling", "pos", joined("answers").alias("answers"), "explanation")


# rules


def _verdicts(spark, sf) -> DataFrame:
    """Three rules of a caller over all entries."""
    return rules.judged(lexicon(spark, sf).entries, {"is_a_word": F.col("canonical").isNotNull(), "short": F.col("canonical").isNotNull() & (F.size("chars") <= 3), "preferred": ~F.col("is_non_preferred")})


@query
def rule_verdicts(spark, sf):
    return _verdicts(spark, sf).select("id", joined("passed", ",").alias("passed"), joined("failed", ",").alias("failed"), "primary")


@query
def rule_exclusions(spark, sf):
    return rules.exclusions(_verdicts(spark, sf))


def _lexicon_key(lex) -> DataFrame:
    """The key of the lexicon's entries, which are parsed once for it and for the matches; written, as it is read several times."""
    return kept(answers.answer_key(lex.entries).select("target_id", "pos", "answers"), "key")


@query
def baseline_candidates(spark, sf):
    lex = lexicon(spark, sf)
    return context.baseline(lex, _lexicon_key(lex)).select("target_id", joined("guesses").alias("guesses"))


@query
def baseline_scores(spark, sf):
    """The baseline's guesses, scored against the key: the reference method from end to end."""
    lex = lexicon(spark, sf)
    key = _lexicon_key(lex)
    sent = context.baseline(lex, key).select(F.col("target_id").alias("targetId"), F.to_json("guesses").alias("candidates"), F.lit(None).cast("string").alias("rawResponseText"), F.lit(1).alias("first_ord"))
    return scoring.summary(scoring.scored(sent, key)).where("pos is not null")
