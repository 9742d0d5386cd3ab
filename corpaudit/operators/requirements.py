"""Requirements: parsed from free text, laid over the baseline, shared over a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpaudit.functions import text as fx

#: Fonts by name with their sizes.
FONTS = {"Times New Roman": 12, "Calibri": 11, "Arial": 11, "Georgia": 11, "Lucida Sans Unicode": 10, "Computer Modern": 10}
_FONT = r"(?i)(times new roman|calibri|arial|georgia|lucida sans unicode|computer modern)\s*,?\s*(\d{1,2})?\s*(?:pt|point)?"
_LEAST = r"(?i)(?:minimum|at least|no fewer than)\s+(?:of\s+)?(\d+|five|four|three|six|seven|eight|nine|ten)\s+(?:references|sources|citations)"
_LEAST_AFTER = r"(?i)(\d+)\+?\s+(?:references|sources)\s+(?:minimum|required)"


def parse_requirements(texts: DataFrame) -> DataFrame:
    """doc_id, font, font_size, abstract_required, running_head_required, min_references, uninterpreted; later lines win."""
    lines = texts.select("doc_id", F.posexplode(F.split("requirements_text", r"\r?\n|[;•]")).alias("pos", "line")).withColumn("line", fx.strip(F.col("line"))).where("line <> ''")
    line, low = F.col("line"), F.lower("line")
    pick = lambda pattern, i: F.when(F.regexp_extract(line, pattern, i) != "", F.regexp_extract(line, pattern, i))
    has_font = line.rlike(_FONT) & low.rlike("font|times new roman|calibri|arial|georgia")
    size_only = ~line.rlike(_FONT) & low.rlike("font|size") & line.rlike(r"(?i)\d{1,2}\s*(?:pt|point)\b")
    abstract = F.when(low.rlike(r"\babstract\b"), F.when(low.rlike(r"\bno abstract\b|without an? abstract|abstract (is )?not (required|needed)"), False).when(low.rlike(r"required|include|must|needs?\b"), True))
    head = F.when(low.contains("running head"), ~low.rlike(r"\bno running head\b|not (required|needed)"))
    least = fx.number_word(F.coalesce(pick(_LEAST, 1), pick(_LEAST_AFTER, 1)))
    rows = lines.select("doc_id", "pos", "line", F.when(has_font, F.initcap(pick(_FONT, 1))).alias("font"), F.when(has_font, pick(_FONT, 2)).when(size_only, pick(r"(?i)(\d{1,2})\s*(?:pt|point)\b", 1)).cast("int").alias("font_size"), abstract.alias("abstract_required"), head.alias("running_head_required"), least.alias("min_references"))
    fields = ["font", "font_size", "abstract_required", "running_head_required", "min_references"]
    left = F.when(F.coalesce(*[F.when(F.col(f).isNotNull(), True) for f in fields]).isNull(), F.struct("pos", "line"))
    out = rows.groupBy("doc_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("pos"))).alias(f) for f in fields], F.array_sort(F.collect_list(left)).alias("left"))
    out = out.withColumn("uninterpreted", F.transform("left", lambda x: x["line"])).drop("left")
    return texts.select("doc_id").distinct().join(out.hint("merge"), "doc_id", "left")


def effective_requirements(settings: DataFrame) -> DataFrame:
    """Settings (doc_id, paper_type and parsed fields) over the baseline, with notes on what was overridden."""
    sizes = F.create_map(*[F.lit(x) for name, size in FONTS.items() for x in (name.lower(), size)])
    font = F.coalesce("font", F.lit("Times New Roman"))
    size = F.coalesce("font_size", F.when(F.col("font").isNotNull(), F.coalesce(sizes[F.lower("font")], F.lit(12))), F.lit(12))
    professional = F.col("paper_type") == "professional"
    head = F.coalesce("running_head_required", professional)
    word = lambda c: F.when(c, "required").otherwise("not required")
    notes = F.array_compact(F.array(
        F.when(F.col("font").isNotNull(), F.concat(F.lit("Instructor override: font "), font, F.lit(" "), size.cast("string"), F.lit(" pt"))).when(F.col("font_size").isNotNull(), F.concat(F.lit("Instructor override: font size "), size.cast("string"), F.lit(" pt"))),
        F.when(F.col("running_head_required").isNotNull() & (F.col("running_head_required") != professional), F.concat(F.lit("Instructor override: running head "), word(F.col("running_head_required")))),
        F.when(F.col("abstract_required").isNotNull(), F.concat(F.lit("Instructor override: abstract "), word(F.col("abstract_required")))),
        F.when(F.col("min_references").isNotNull(), F.concat(F.lit("Instructor requirement: minimum "), F.col("min_references").cast("string"), F.lit(" references"))),
    ))
    return settings.select("doc_id", "paper_type", font.alias("font"), size.alias("font_size"), "abstract_required", head.alias("running_head_required"), "min_references", notes.alias("overrides"), *[c for c in ("metadata",) if c in settings.columns])


def batch_settings(shared: dict, detected: DataFrame) -> DataFrame:
    """Shared settings for every document, with its own title and author; no author becomes Name."""
    fixed = [F.lit(v).alias(k) for k, v in shared.items()]
    return detected.select("doc_id", *fixed, F.col("metadata.title").alias("title"), F.coalesce("metadata.author", F.lit("Name")).alias("author"), F.col("metadata.title").isNull().alias("no_title"))
