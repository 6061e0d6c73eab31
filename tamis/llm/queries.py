"""The registered queries of this package, thin over its operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import dart_minhash, elias_fano, gam_quality, html_templates, kd_shards, matrix_bpe, multiprobe, oph_fingerprint, site_spread, tiling, turn_repair, unit_dedup, whitening
from tamis.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op1_html_templates(spark, sf_dir):
    """The main text of every page."""
    texts = html_templates.main_texts(table(spark, sf_dir, "pages"))
    return texts.select(F.col("key").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query()
def op2_oph_fingerprint(spark, sf_dir):
    """Fingerprints of every text and of its edited text, with their likenesses."""
    made = oph_fingerprint.edited_prints(table(spark, sf_dir, "documents"))
    return made.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        oph_fingerprint.as_text(F.col("print")).alias("fingerprint"),
        oph_fingerprint.as_text(F.col("edited_print")).alias("edited_fingerprint"),
        oph_fingerprint.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        oph_fingerprint.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


@query()
def op3_string_tiling(spark, sf_dir):
    """Every document and benchmark item that the document leaks, with the share covered and the tiles."""
    found = tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "coverage", F.size("tiles").alias("n_tiles"), "tiles")


@query()
def op4_kd_shards(spark, sf_dir):
    """All documents in 16 shards of near equal bytes, with gapless slots."""
    dealt = kd_shards.kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return dealt.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    """
    WITH cut AS (SELECT doc_id, coalesce(source, chr(1)) AS site, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (SELECT doc_id, site, unnest(parts) AS line, unnest(range(len(parts))) AS position FROM cut),
    wide AS (SELECT trim(line, ' ' || chr(9) || chr(13)) AS plain FROM lines WHERE plain <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10),
    marked AS (SELECT l.doc_id, l.line, l.position, w.plain IS NOT NULL AS gone FROM lines l LEFT JOIN wide w ON trim(l.line, ' ' || chr(9) || chr(13)) = w.plain)
    SELECT doc_id, CAST(count(*) AS INTEGER) AS lines_before, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS lines_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE NOT gone), '')) AS text_sha256
    FROM marked GROUP BY doc_id
    """
)
def op5_site_spread(spark, sf_dir):
    """Every document without the lines that ten or more sites carry."""
    kept = site_spread.drop_boilerplate(table(spark, sf_dir, "documents"), report=True)
    return kept.select("doc_id", "lines_before", F.size("removed_lines").alias("lines_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query()
def op6_gam_quality(spark, sf_dir):
    """A quality score for every document, by a model fitted on labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = gam_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = gam_quality.score(docs, model)
    return scored.select(
        F.col("key").alias("doc_id"), gam_quality.held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= gam_quality.THRESHOLD).cast("int").alias("predicted")
    )


@query()
def op7_dart_minhash(spark, sf_dir):
    """Every document with the class of near duplicates that it belongs to."""
    found = dart_minhash.near_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "class_id", "class_size")


@query(
    r"""
    WITH cut AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS parts FROM documents WHERE text IS NOT NULL),
    numbered AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM cut),
    laid AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
                    trim(regexp_replace(lower(part), '[ \t\r\f\v\n]+', ' ', 'g')) AS unit FROM numbered),
    units AS (SELECT doc_id, unit, row_number() OVER w AS nth, ahead + length(part) - length(ltrim(part, e' \t\r\f\v\n')) AS s, ahead + length(rtrim(part, e' \t\r\f\v\n')) AS e,
                     length(unit) - length(replace(unit, ' ', '')) + 1 AS words FROM laid WHERE unit <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
    beside AS (SELECT *, coalesce(lag(words) OVER w, 0) AS words_before, coalesce(lead(words) OVER w, 0) AS words_after FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY nth)),
    ranked AS (SELECT *, first_value(doc_id) OVER w AS kept_doc, first_value(s) OVER w AS kept_s, first_value(nth) OVER w AS kept_nth, row_number() OVER w > 1 AS loses,
                      count(*) OVER (PARTITION BY unit) AS copies FROM beside WINDOW w AS (PARTITION BY unit ORDER BY doc_id, s)),
    again AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM ranked WHERE copies > 1),
    measured AS (SELECT *, sum(words) OVER r + arg_min(words_before, nth) OVER r + arg_max(words_after, nth) OVER r AS long,
                        sum(CASE WHEN loses THEN words ELSE 0 END) OVER (PARTITION BY doc_id, run, kept_doc, kept_nth - nth) AS same
                 FROM again WINDOW r AS (PARTITION BY doc_id, run)),
    judged AS (SELECT *, max(same) OVER (PARTITION BY doc_id, run) AS in_order FROM measured)
    SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", kept_doc AS kept_doc_id, CAST(kept_s AS BIGINT) AS kept_start, copies, md5(unit) AS digest
    FROM judged WHERE loses AND long >= 50 AND in_order >= 15
    """
)
def op8_unit_dedup(spark, sf_dir):
    """Every sentence or line end of a repeated run that an earlier place already has, with its original offsets."""
    spans = unit_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select(
        F.col("key").alias("doc_id"), "start", "end", F.col("kept_key").alias("kept_doc_id"), "kept_start", "copies", F.lower(F.hex("digest")).alias("digest")
    )


@query()
def op9_elias_fano(spark, sf_dir):
    """Token ids of every document, written to files with Elias-Fano boundaries and read back."""
    written = elias_fano.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return elias_fano.read_tokens(*written, with_ids=False).withColumnRenamed("key", "doc_id")


@query()
def op10_matrix_bpe(spark, sf_dir):
    """Ids of every document by the matrix encoder, and the bytes that they decode to."""
    coded = matrix_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)
    return coded.withColumnRenamed("key", "doc_id")


@query()
def op11_turn_repair(spark, sf_dir):
    """Faults, cheapest repair and digest of the repaired turns of every conversation, after known damage."""
    rows = turn_repair.damaged(turn_repair.turns(table(spark, sf_dir, "conversations")))
    found, mended = turn_repair.repair(rows)
    digests = turn_repair.digests(mended).withColumnRenamed("key", "same")
    joined = found.join(digests, F.col("key").eqNullSafe(F.col("same")))
    return joined.select(F.col("key").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))


@query()
def op12_whitening(spark, sf_dir):
    """Every usable embedding whitened along up to 16 components, one row each."""
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"))
    shares = F.lit([float(v / model.trace) for v in model.values]) if len(model.values) else F.lit(None).cast("array<double>")
    placed = rows.select("key", "n", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return placed.select(
        F.col("key").alias("vec_id"),
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


@query()
def op13_multiprobe(spark, sf_dir):
    """The 20 nearest rows of every twentieth embedding, by largest inner product."""
    found = multiprobe.nearest(table(spark, sf_dir, "embeddings"), F.col("key") % 20 == 0)
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("found").alias("vec_id"), "score")
