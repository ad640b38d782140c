"""Document identity: digests, first-wins storing, resubmission, latest verdict, routing, field rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed

# Image extensions, and the limits of the text route.
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tif", ".tiff")
LEAST_TEXT = 120
MOST_TEXT = 6000
MOST_BYTES = 25 * 1024 * 1024


def unseen(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The first row (by read_at, path) of each digest that is not stored yet; stored documents are left as they are."""
    first = docs.groupBy("digest").agg(F.min_by(F.struct(*[c for c in docs.columns if c != "digest"]), F.struct("read_at", "path")).alias("d"))
    return first.join(known.select("digest"), "digest", "left_anti").select("digest", "d.*")


def reconciled_before(digests: DataFrame, documents: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """Adds ``seen``: whether a document of that digest has a reconciliation."""
    done = documents.join(reconciliations, documents["id"] == reconciliations["document_id"], "left_semi").select("digest").distinct()
    return digests.join(done.withColumn("seen", F.lit(True)), "digest", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def latest(reconciliations: DataFrame) -> DataFrame:
    """The reconciliation of highest id of each document."""
    rest = [c for c in reconciliations.columns if c not in ("id", "document_id")]
    return reconciliations.groupBy("document_id").agg(F.max("id").alias("id"), F.max_by(F.struct(*rest), "id").alias("r")).select("document_id", "id", "r.*")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def page_text(text: Column) -> Column:
    """A text layer with runs of blanks and of empty lines collapsed."""
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def routed(files: DataFrame) -> DataFrame:
    """files: (path, exists, length bytes, text, failure: why the text layer could not be read, or null).

    Adds kind, reason - the fact that decided: the missing file, the failure, the characters found, the extension - and the
    text that the text route hands on.
    """
    c = F.col
    ext, text = extension(c("path")), page_text(F.coalesce(c("text"), F.lit("")))
    image, pdf = ext.isin(*IMAGES), ext == ".pdf"
    size = F.round(c("length") / 1e6).cast("bigint").cast("string")
    too_large = F.when(c("length") > MOST_BYTES, F.concat(F.lit("PDF is "), size, F.lit(" MB, too large to parse safely")))
    failure = F.coalesce(too_large, c("failure"))
    characters = F.length(text)
    kind = F.when(~c("exists"), "unsupported").when(image, "image").when(~pdf, "unsupported").when(failure.isNotNull() | (characters < LEAST_TEXT), "pdf-needs-render").otherwise("text")
    reason = (
        F.when(~c("exists"), "file not found")
        .when(pdf & failure.isNotNull(), F.concat(F.lit("text extraction failed ("), failure, F.lit(")")))
        .when(pdf & (characters < LEAST_TEXT), F.concat(F.lit("only "), characters.cast("string"), F.lit(" characters of text, treating it as a scan")))
        .when(~pdf & ~image, F.concat(F.lit("unsupported file type "), F.when(ext == "", "(none)").otherwise(ext)))
    )
    return files.withColumn("kind", kind).withColumn("reason", reason).withColumn("page_text", F.when(kind == "text", F.substring(text, 1, MOST_TEXT)))


def field_rows(verdicts: DataFrame) -> DataFrame:
    """Stored form of judged fields: amounts as minor units, other values as text, abstentions too."""
    amount = F.col("type") == "amount"
    return verdicts.select(
        F.col("doc_id").alias("document_id"), "key", "type", F.when(~amount, F.col("value")).alias("value_text"), F.when(amount, F.col("value").cast("decimal(38,0)").cast("bigint")).alias("value_minor"),
        F.col("verdict.admitted").alias("admitted"), F.col("verdict.check").alias("check_failed"), "confidence", F.col("verdict.binding").alias("width"), "source",
    )


def wide(fields: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each document with a struct<value, admitted, check> for each key of the template."""
    of = F.struct(F.coalesce(F.col("value_minor").cast("string"), F.col("value_text")).alias("value"), "admitted", F.col("check_failed").alias("check"))
    return fields.groupBy("document_id").agg(*[F.first(F.when(F.col("key") == k, of), ignorenulls=True).alias(k) for k in keys])
