"""The pluggable extraction step between a scan and the archive's tables.

An extractor maps a batch of files to JSON payloads; it runs inside tasks, a partition at a
time, and its failures become marked payloads that the next ingest takes up again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.functions import exprs

_S = T.StringType()
_FIELDS = ("title", "date_depicted", "date_range_start", "date_range_end", "location", "medium_category", "medium", "dimensions", "description", "language", "transcription")
PAYLOAD = T.StructType(
    [T.StructField(f, _S) for f in _FIELDS]
    + [
        T.StructField("entities", T.ArrayType(T.StructType([T.StructField(f, _S) for f in ("name", "type", "role", "context")]))),
        T.StructField("transactions", T.ArrayType(T.StructType([T.StructField(f, _S) for f in ("seller", "buyer", "date", "price", "currency", "auction_house", "lot_number", "location", "notes")]))),
        T.StructField("tags", T.ArrayType(_S)),
    ]
)
FAILED = "Extraction failed"


def offline(filename: str) -> str:
    """A deterministic stand-in: the file's name as title."""
    return json.dumps({"title": filename.rsplit(".", 1)[0], "description": f"File {filename}", "entities": [], "transactions": [], "tags": []})


def extracted(files: DataFrame, extractor: Callable[[str], str] = offline, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """files with a payload column; a file whose extractor keeps failing gets the failure marker."""

    def run(batches):
        for batch in batches:
            out = []
            for name in batch["filename"]:
                for attempt in range(tries):
                    try:
                        out.append(extractor(name))
                        break
                    except Exception as error:  # noqa: BLE001 an extractor is any user's code
                        if attempt + 1 == tries:
                            out.append(json.dumps({"description": f"{FAILED}: {type(error).__name__}"}))
                        else:
                            time.sleep(pause * 2**attempt)
            yield batch.assign(raw_extraction=out)

    return files.mapInPandas(run, T.StructType([*files.schema.fields, T.StructField("raw_extraction", _S)]))


def decoded(files: DataFrame) -> DataFrame:
    """Payloads without code fences as columns; dates and categories cleaned."""
    bare = F.regexp_replace("raw_extraction", r"^\s*```[a-z]*\s*|\s*```\s*$", "")
    out = files.withColumn("p", F.from_json(bare, PAYLOAD)).select(*files.columns, "p.*")
    return out.withColumns(
        {
            "date_depicted": exprs.scrubbed_date(F.col("date_depicted")),
            "medium_category": exprs.chosen_category(F.col("medium_category"), F.col("medium")),
            "embed_text": exprs.embed_text(F.col("title"), F.col("description"), F.array_join("tags", " ")),
        }
    )


def transactions(documents: DataFrame, least: int = 2) -> DataFrame:
    """Each document's transactions with numbers read and weak ones left out."""
    t = documents.select("sha256", F.explode("transactions").alias("t")).select("sha256", "t.*")
    t = t.withColumns({"price": exprs.price(F.col("price")), "lot_number": exprs.lot_number(F.col("lot_number"))})
    score = exprs.transaction_score(*(F.col(c) for c in ("seller", "buyer", "date", "price", "auction_house")))
    return t.where(F.lit(least <= 0) | (score >= least))


def mentions(documents: DataFrame) -> DataFrame:
    """Entities of the payloads, one row for each, with names normalised."""
    e = documents.select("sha256", F.explode("entities").alias("e")).select("sha256", "e.*")
    return e.withColumn("normalized_name", exprs.normalized_name(F.col("name"))).where("normalized_name <> ''")


def evidence(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """An edge's evidence ids that are documents."""
    ids = edges.select("source", "target", F.explode("evidence_doc_ids").alias("id"))
    return ids.join(documents.select("id", "title"), "id").select("source", "target", "id", "title")


def reextracted(documents: DataFrame, fresh: DataFrame, archive: Column, now: Column) -> DataFrame:
    """M7: documents whose content was extracted again, in place: what an extraction fills is new, ids, annotations and key flags
    stay, an archive is named only where none was. fresh: sha256 and described fields, one row for each content."""
    fields = [c for c in (*_FIELDS, "raw_extraction") if c in documents.columns and c in fresh.columns]
    new = fresh.select("sha256", F.lit(True).alias("_again"), *(F.col(c).alias(f"_{c}") for c in fields))
    out = documents.join(new, "sha256", "left")
    again = F.coalesce("_again", F.lit(False))
    changes = {c: F.when(again, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    changes |= {"source_archive": F.when(again, F.coalesce("source_archive", archive)).otherwise(F.col("source_archive")), "updated_at": F.when(again, now).otherwise(F.col("updated_at"))}
    return out.withColumns(changes).select(*documents.columns)
