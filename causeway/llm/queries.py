"""Registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.llm import ann, exact, images, jaccard, licences, lines, packing, pieces, resample, runs, substring, toxicity, warc
from causeway.llm.common import WORD_SPLIT, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), jaccard.Rule(n=4, num=85, den=100))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "flagged")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


LINE_RATIO, LINE_PAGES = 0.05, 3


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(table(spark, sf_dir, "documents"), ratio=LINE_RATIO, least_pages=LINE_PAGES)
    return kept.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256")
    )


def line_dedup_sql(docs: str, columns: str) -> str:
    """The rows of ``docs`` with boilerplate lines dropped, as the columns doc_id, kept, n_lines, n_removed and ``columns``."""
    return f"""
lined as (
  select doc_id, source, text, string_split(text, chr(10)) as lines from {docs}),
hosts as (select source, count(*) as pages from {docs} group by source),
seen as (
  select source, unnest(list_distinct(list_transform(lines, lambda x: trim(x, ' ')))) as line from lined where text is not null),
often as (
  select seen.source as source, line from seen join hosts on seen.source is not distinct from hosts.source
  where line <> '' group by seen.source, line
  having count(*) >= {LINE_PAGES} and count(*) > {LINE_RATIO} * max(pages)),
bad as (select source, list(line) as bad from often group by source),
deduped as (
  select lined.doc_id, {columns}
         case when lined.text is null then null
              else array_to_string(list_filter(lines, lambda x: not list_contains(coalesce(bad, []), trim(x, ' '))), chr(10)) end as kept,
         coalesce(len(lines), 0) as n_lines,
         coalesce(len(lines) - len(list_filter(lines, lambda x: not list_contains(coalesce(bad, []), trim(x, ' ')))), 0) as n_removed
  from lined left join bad on lined.source is not distinct from bad.source)"""


OP1_SQL = f"""
with {line_dedup_sql("documents", "")}
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_removed as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from deduped
"""


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmentations(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), n=3)


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"), threshold=LICENCE_DICE)
    best = F.element_at(F.array_sort(F.transform("matches", lambda m: F.struct((-m.dice).alias("loss"), m.template.alias("template")))), 1)
    return (
        found.withColumn("best", F.when(F.size("matches") > 0, best))
        .select("doc_id", F.size("matches").cast("long").alias("n_passages"), F.col("best.template").alias("licence"), (-F.col("best.loss")).alias("dice"))
    )


LICENCE_DICE = 0.8


def licence_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    shapes = [(n, licences.template_bigrams(t)) for n, t in sorted(licences.TEMPLATES.items())]
    known = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, own))}])" for n, own in shapes)
    return f"""
with t(name, grams) as (values {known}),
p as (
  select doc_id, unnest(list_distinct(list_concat(
    string_split(coalesce(text, ''), chr(10)),
    list_filter(regexp_split_to_array(coalesce(text, ''), '\n[ \t]*\n'), lambda x: contains(trim(x, ' '), chr(10)))))) as passage
  from documents),
w as (select doc_id, string_split(trim(regexp_replace(lower(passage), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), ' ') as words, passage from p),
g as (
  select doc_id, passage,
         list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as grams
  from w where len(words) > 1),
d as (
  select doc_id, passage, name, 2.0::double * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) as dice
  from g join t on len(g.grams) between {LICENCE_DICE} / (2 - {LICENCE_DICE}) * len(t.grams) and (2 - {LICENCE_DICE}) / {LICENCE_DICE} * len(t.grams)),
b as (select doc_id, passage, max(dice) as dice, arg_min(name, (-dice, name)) as name from d where dice >= {LICENCE_DICE} group by doc_id, passage),
r as (select doc_id, count(*) as n_passages, arg_min(name, (-dice, name)) as licence, max(dice) as dice from b group by doc_id)
select documents.doc_id, coalesce(n_passages, 0) as n_passages, licence, dice from documents left join r on documents.doc_id = r.doc_id
"""


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.find_copies(images.rendered(table(spark, sf_dir, "embeddings")))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(ann.build_index(vectors), vectors.where("vec_id % 50 = 0"), k=5)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), k=20)
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), WORD_SPLIT, " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(words, "UTF-8"), 256).alias("kept_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as payload_bytes, sha256(body) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resample.importance_resample(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
g as (
  select doc_id, norm, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
         row_number() over (partition by norm order by doc_id desc nulls last) as place
  from d)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from g
"""


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; in one of ten texts, by their ids, the words from some place on repeat the first few of them."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                g, rest = divmod(zlib.crc32(str(doc).encode()), 10)
                words = text.split() if text and doc is not None and not rest else []
                if not words:
                    texts.append(text)
                    continue
                a = g % len(words)
                p = 1 + (len(words) - a) // (3 + g % 8)
                texts.append(b" ".join([words[i if i < a else a + (i - a) % p] for i in range(len(words))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    held = docs.select("doc_id", "text")
    return held.mapInArrow(plant, held.schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(repeating(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda x: F.concat(x.start.cast("string"), F.lit(","), x.length.cast("string"), F.lit(","), x.period.cast("string"), F.lit("\n")))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    top = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top.start.alias("start"), top.length.alias("length"), top.period.alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.coalesce("collapsed", F.lit(""))).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_pieces": op2_pieces,
        "op3_licence_scan": op3_licence_scan,
        "op4_image_copies": op4_image_copies,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_warc": op7_warc,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_toxicity": op9_toxicity,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": OP1_SQL,
        "op3_licence_scan": licence_sql(),
        "op7_warc": OP7_SQL,
        "op12_exact_dedup": OP12_SQL,
    }
