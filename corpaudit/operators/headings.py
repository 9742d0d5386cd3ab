"""Headings of the body: explicit markers, styles, scored appearance; levels and hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpaudit.functions import text as fx

#: Markers, captions, section words, and words that a shortened heading should not end in.
LEVEL_MARK = r"(?i)^(\[(?:h|heading|level)\s*([1-5])\]|(?:heading|level)\s*([1-5])\s*(?::|-|–))\s*(.+)$"
NUMBERED_SUB = r"(?i)^(\[?sub[\s-]*heading\s*([1-4])\]?\s*(?::|-|–)?\s*)(.+)$"
PLAIN_SUB = r"(?i)^(\[?sub[\s-]*heading\]?\s*(?::|-|–)?\s*)(.+)$"
CAPTION = r"(?i)^(?:table|figure)\s+\d+\.?$|^note\.\s"
SECTION_WORD = (
    r"(?i)^(introduction|method|methods|methodology|results|discussion|conclusion|conclusions|literature review|background|limitations|implications|recommendations|"
    r"summary|findings|analysis|participants|procedure|procedures|materials|measures|design|data analysis|future research|theoretical framework)$"
)
CITES = r"\((?:1[6-9]|20)\d{2}[a-z]?\)|\([^)]*,\s*(?:1[6-9]|20)\d{2}"
WEAK_ENDS = "a an the and but or nor so yet for of to in on at by with as than that this it its is are was were".split()


def shortened(text: Column) -> Column:
    """At most eight words of a sentence, backing off weak last words down to five."""
    bare = F.trim(F.regexp_replace(text, r"\.+$", ""))
    words = F.split(bare, r"\s+")
    weak = F.array(*map(F.lit, WEAK_ENDS))
    cut = F.lit(8)
    for n in (5, 6, 7, 8):
        cut = F.when(~F.array_contains(weak, F.lower(F.get(words, F.lit(n - 1)))), n).otherwise(cut)
    return F.when(F.size(words) <= 8, bare).otherwise(F.array_join(F.slice(words, F.lit(1), cut), " "))


def headings(annotated: DataFrame, style_names: DataFrame | None = None) -> DataFrame:
    """doc_id, p_idx, text, level, confidence, score, signals, from_style, marker of every heading of the body."""
    df = annotated.where("in_body and not inside_table")
    if style_names is not None:
        df = df.join(style_names.select("doc_id", "style_id", F.col("name").alias("style_name")).hint("merge"), ["doc_id", "style_id"], "left")
    else:
        df = df.withColumn("style_name", F.lit(None).cast("string"))
    t, words = F.col("t"), F.col("n_words")
    level_mark, sub_n, sub = t.rlike(LEVEL_MARK), t.rlike(NUMBERED_SUB), t.rlike(PLAIN_SUB)
    style = F.regexp_extract(F.lower(F.coalesce("style_name", "style_id", F.lit(""))), r"^heading ?([1-5])$", 1)
    bold, italic = F.coalesce(F.col("run_props.bold"), F.lit(False)), F.coalesce(F.col("run_props.italic"), F.lit(False))
    centered = F.coalesce(F.col("props.alignment") == "center", F.lit(False))
    stop = t.endswith(".") & ~t.rlike(r"^\d")
    section, titled, followed = t.rlike(SECTION_WORD), fx.title_case_like(t), F.coalesce(F.col("next_words") > 20, F.lit(False))
    body = (words > 14) | F.col("has_numbering") | t.rlike(CITES)
    sentence = ~bold & ~centered & ~section & stop
    parts = [("bold", bold, 30), ("centered", centered, 15), ("italic", italic, 5), ("short", words <= 8, 15), ("no terminal punctuation", ~stop, 10), ("title case", titled, 10), ("common section heading word", section, 25), ("followed by body paragraph", followed, 10)]
    score = sum((F.when(test, points).otherwise(0) for _, test, points in parts), F.lit(0))
    signals = F.array_compact(F.array(*[F.when(test, name) for name, test, _ in parts]))
    group = lambda pattern, i: F.regexp_extract(t, pattern, i)
    row = lambda text, level, score, signals, kind, from_style=False: F.struct(text.alias("text"), level.cast("int").alias("level"), score.cast("int").alias("score"), signals.alias("signals"), F.lit(kind).alias("kind"), F.lit(from_style).alias("from_style"))
    one = lambda s: F.array(F.lit(s))
    numbered = group(NUMBERED_SUB, 2)
    found = (
        F.when(t.rlike(CAPTION), None)
        .when(level_mark, row(F.trim(group(LEVEL_MARK, 4)), F.coalesce(F.when(group(LEVEL_MARK, 2) != "", group(LEVEL_MARK, 2)), group(LEVEL_MARK, 3)), F.lit(120), one("explicit level marker"), "apa_level"))
        .when(sub_n, row(F.trim(group(NUMBERED_SUB, 3)), F.when(numbered != "", numbered).cast("int") + 1, F.lit(120), one("explicit subheading marker"), "subheading"))
        .when(sub, row(F.trim(group(PLAIN_SUB, 2)), F.lit(2), F.lit(115), one("generic subheading marker"), "generic_subheading"))
        .when(style != "", row(t, F.when(style != "", style), F.lit(100), one("Word style"), None, True))
        .when(body, None)
        .when(sentence, F.when((words <= 12) & titled & followed, row(shortened(t), F.lit(1), F.lit(80), F.array(F.lit("short"), F.lit("title case"), F.lit("followed by body paragraph")), "rephrased_heading")))
        .when(stop & ~bold, None)
        .when(score >= 45, row(t, F.lit(1), score, signals, None))
    )
    rows = df.select("doc_id", "p_idx", "body_start", found.alias("h")).where("h is not null").select("doc_id", "p_idx", "body_start", "h.*")
    # ordinals of plain subheadings: they count on from a numbered one and start anew at a level-1 heading
    order = Window.partitionBy("doc_id").orderBy("p_idx")
    resets = F.when(F.col("kind") == "subheading", F.col("level") - 1).when((F.col("level") == 1) & F.coalesce(F.col("kind") != "generic_subheading", F.lit(True)), 0)
    rows = rows.withColumn("base", resets).withColumn("run", F.count("base").over(order))
    within = Window.partitionBy("doc_id", "run").orderBy("p_idx")
    plain = F.coalesce(F.col("kind") == "generic_subheading", F.lit(False))
    ordinal = F.least(F.lit(4), F.coalesce(F.first("base", ignorenulls=True).over(within), F.lit(0)) + F.count_if(plain).over(within))
    rows = rows.withColumn("ordinal", F.when(plain, ordinal).when(F.col("kind") == "subheading", F.col("level") - 1)).withColumn("level", F.when(plain, ordinal + 1).otherwise(F.col("level")).cast("int"))
    confidence = F.when(F.col("score") >= 75, "high").when(F.col("score") >= 55, "medium").otherwise("low")
    return rows.select("doc_id", "p_idx", "body_start", "text", "level", confidence.alias("confidence"), "score", "signals", "from_style", F.struct("kind", "ordinal").alias("marker"))


def without_title(found: DataFrame, structure: DataFrame) -> DataFrame:
    """Without the paper's title where it is repeated at the start of the body."""
    title = structure.select("doc_id", F.trim(F.col("metadata.title")).alias("title"))
    rows = found.join(title.hint("merge"), "doc_id", "left")
    return rows.where(~F.coalesce((F.col("p_idx") == F.col("body_start")) & (F.trim("text") == F.col("title")), F.lit(False))).drop("title", "body_start")


def normalize_levels(found: DataFrame) -> DataFrame:
    """Style levels move up together if none of them is 1; marked headings stay."""
    styled = F.col("from_style") & F.col("marker.kind").isNull()
    least = F.min(F.when(styled, F.col("level"))).over(Window.partitionBy("doc_id"))
    return found.withColumn("least", least).withColumn("level", F.when(styled, F.greatest(F.lit(1), F.col("level") - (F.col("least") - 1))).otherwise(F.col("level")).cast("int")).drop("least")


def headings_of(annotated: DataFrame, structure: DataFrame, style_names: DataFrame | None = None) -> DataFrame:
    return normalize_levels(without_title(headings(annotated, style_names), structure))


def heading_skips(found: DataFrame) -> DataFrame:
    """Headings more than one level below the one before, with that one's level."""
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("p_idx"))
    return found.withColumn("previous_level", before).where("previous_level > 0 and level > previous_level + 1")


def apply_forced(found: DataFrame, forced: DataFrame, paras: DataFrame | None = None) -> DataFrame:
    """Levels set by users win; level 0 makes a heading body text. Of several for one paragraph the highest level counts.

    paras (doc_id, p_idx, t): any of its paragraphs may be made a heading, found or not; a place that no paragraph has is ignored.
    """
    asked = forced.where("level is not null").groupBy("doc_id", "p_idx").agg(F.max("level").cast("int").alias("forced"))
    if paras is None:
        rows = found.join(asked.hint("merge"), ["doc_id", "p_idx"], "left")
    else:
        asked = asked.join(paras.select("doc_id", "p_idx", F.col("t").alias("own_text")).hint("merge"), ["doc_id", "p_idx"])
        rows = found.join(asked.hint("merge"), ["doc_id", "p_idx"], "full").withColumn("text", F.coalesce("text", "own_text")).drop("own_text")
        rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit("high"))).withColumn("score", F.coalesce("score", F.lit(120))).withColumn("signals", F.coalesce("signals", F.array(F.lit("set by a user"))))
    set_ = F.col("forced").isNotNull()
    return rows.withColumn("level", F.coalesce("forced", "level")).withColumn("from_style", set_ | F.coalesce("from_style", F.lit(False))).drop("forced").where("level > 0")


def marker_text(text: Column, level: Column) -> Column:
    """Clean title of a marked heading; levels 4 and 5 run in and end in a full stop."""
    titled = fx.title_case(text)
    return F.when((level >= 4) & ~titled.rlike("[.?!]$"), F.concat(titled, F.lit("."))).otherwise(titled)
