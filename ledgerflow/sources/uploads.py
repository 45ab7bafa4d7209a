"""File drops to document metadata (the upload policy as a batch job)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import file_ext
from .schemas import ALLOWED_UPLOAD_TYPES, MAX_UPLOAD_BYTES, MAX_UPLOAD_FILES

S = F.col


def read_upload_dir(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """List a drop folder ``<path>/<batch>/<file>`` without reading contents.

    The binaryFile source prunes the ``content`` column when it is not
    selected, so only names and sizes are read.  Each sub-folder is one
    upload request (batch).
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    return files.select(
        F.regexp_extract(S("path"), r"/([^/]+)/[^/]+$", 1).alias("batch_id"),
        S("path").alias("file_id"),
        F.regexp_extract(S("path"), r"([^/]+)$", 1).alias("file_name"),
        S("length").alias("size"))


def upload_manifest(files: DataFrame, allowed=ALLOWED_UPLOAD_TYPES, max_bytes=MAX_UPLOAD_BYTES,
                    max_files=MAX_UPLOAD_FILES, document_type=None) -> DataFrame:
    """Classify uploaded files: accepted metadata rows or a reason.

    ``files``: batch_id, file_id, file_name, size[, document_type].
    A request fails as a whole, as the upload handler does: more than
    ``max_files`` files, or any file of a wrong type or too big, rejects every
    file of the batch (the others with ``batch_rejected``).  The per-batch
    figures come from a grouped aggregate joined back (no window holding a
    whole batch in one task).  Document type defaults to ``other``.
    """
    f = files.withColumn("ext", file_ext("file_name"))
    file_reason = (F.when(~S("ext").isin(list(allowed)), F.lit("file_type_not_allowed"))
                   .when(S("size") > F.lit(max_bytes), F.lit("file_too_large")))
    f = f.withColumn("__file_reason", file_reason)
    per_batch = (f.groupBy(S("batch_id").alias("__b"))
                 .agg(F.count(F.lit(1)).alias("__n"),
                      F.count(S("__file_reason")).alias("__bad")))
    j = f.join(per_batch, S("batch_id") == S("__b"), "left")
    reason = (F.when(S("__n") > F.lit(max_files), F.lit("too_many_files"))
              .when(S("__file_reason").isNotNull(), S("__file_reason"))
              .when(S("__bad") > 0, F.lit("batch_rejected")))
    dtype = (F.coalesce(S("document_type"), F.lit("other")) if "document_type" in files.columns
             else F.lit(document_type or "other"))
    return j.select("batch_id", "file_id", "file_name", "ext", "size",
                    dtype.alias("document_type"), reason.isNull().alias("accepted"),
                    reason.alias("reason"))
