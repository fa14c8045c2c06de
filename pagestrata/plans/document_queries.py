"""Queries over document text: cleaning, chunks, duplicates, truncation, selection, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.evaluator import RuleEvaluator, evaluate_batches
from pagestrata.functions import text as T
from pagestrata.operators import chunks as CH
from pagestrata.operators import inventory as I
from pagestrata.operators import review as R
from pagestrata.operators import validate as VA
from pagestrata.operators.selection import (
    pack_batches, ranked, select_for_analysis, selection_scores, truncate_sections,
)
from pagestrata.plans import inputs as V
from pagestrata.plans.catalogue import query


@query(f"SELECT doc_id, length(t) AS length, 'sha256:' || sha256(t) AS digest FROM (SELECT doc_id, {V.clean_sql('text')} AS t FROM documents)")
def clean_text(spark, folder):
    """Every document cleaned, as length and digest."""
    rows = V.heavy_table(spark, folder, "documents", "doc_id").withColumn("t", T.clean_text(F.col("text")))
    return rows.select("doc_id", F.length("t").alias("length"), T.sha256(F.col("t")).alias("digest"))


@query("""SELECT doc_id, CASE WHEN doc_id = owner THEN 'rendered' ELSE 'duplicate' END AS status,
  CASE WHEN doc_id <> owner THEN 'https://' || owner_source || '.example.com/doc/' || owner END AS duplicate_of
  FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS owner, first(source) OVER (PARTITION BY text ORDER BY doc_id) AS owner_source FROM documents)""")
def content_digest_dedup(spark, folder):
    """Documents with the same text: the first owns it, the others are duplicates of it."""
    pages = V.document_pages(spark, folder).select("doc_id", "site", "url", "ordinal", "status", "content_digest")
    return I.mark_duplicates(pages, ("content_digest",)).select("doc_id", "status", "duplicate_of")


@query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  kept AS (SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM lines WHERE line <> '')
  SELECT doc_id, count(*) FILTER (upto <= 1500) AS sections, coalesce(sum(length(line)) FILTER (upto <= 1500), 0)::BIGINT AS character_count,
   bool_or(upto > 1500) AS truncated FROM kept GROUP BY doc_id""")
def section_truncate(spark, folder):
    """Lines of a document kept as sections within 1500 characters."""
    rows = V.table(spark, folder, "documents")
    sections = F.transform(F.filter(F.split("text", "\n"), lambda t: t != ""), lambda t: T.record(text=t))
    cut = rows.select("doc_id", truncate_sections(sections, 1500).alias("_t"))
    return cut.select("doc_id", F.size("_t.sections").alias("sections"), F.col("_t.character_count").alias("character_count"),
                      F.col("_t.truncated").alias("truncated"))


_PARAGRAPHS = "string_split_regex(" + V.clean_sql("replace(text, chr(10), chr(10) || ' ' || chr(10))") + r", '\n\s*\n')"


@query(f"""WITH parts AS (SELECT doc_id, list_filter({_PARAGRAPHS}, lambda p: p <> '') AS ps FROM documents),
  chunks AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) AS index FROM parts)
  SELECT doc_id, index, 'paragraph' AS kind, 'Paragraph ' || index AS label, length(text) AS length, sha256(text) AS digest FROM chunks""")
def paragraph_chunks(spark, folder):
    """Documents with a blank line at every line end, as paragraphs."""
    rows = V.heavy_table(spark, folder, "documents", "doc_id").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n \n")))
    chunks = CH.text_chunks(rows, "doc_id")
    return chunks.select("doc_id", "index", "kind", "label", F.length("text").alias("length"), F.sha2("text", 256).alias("digest"))


_MARKDOWN = "replace(replace('# ' || text, chr(10), chr(10) || '## Part ' || lang || chr(10)), '. ', '.' || chr(10))"


@query(f"""WITH cleaned AS (SELECT doc_id, string_split({V.clean_sql(_MARKDOWN)}, chr(10)) AS ls FROM documents),
  lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cleaned),
  marked AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+.+$') THEN {V.clean_sql("regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)")} END AS heading FROM lines),
  blocks AS (SELECT *, count(*) FILTER (heading IS NOT NULL OR trim(line) = '') OVER w AS block,
    coalesce(last_value(heading IGNORE NULLS) OVER w, 'Document') AS title FROM marked
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  chunks AS (SELECT doc_id, block, min(pos) AS index, max(pos) AS last, any_value(title) AS title, string_agg(line, chr(10) ORDER BY pos) AS text
    FROM blocks WHERE heading IS NULL AND trim(line) <> '' GROUP BY doc_id, block)
  SELECT doc_id, index, title || ' · lines ' || index || '-' || last AS label, length({V.clean_sql('text')}) AS length, sha256({V.clean_sql('text')}) AS digest FROM chunks""")
def markdown_chunks(spark, folder):
    """Documents as Markdown with headings, in located blocks."""
    rows = V.heavy_table(spark, folder, "documents", "doc_id")
    part = F.concat(F.lit("\n## Part "), "lang", F.lit("\n"))
    text = F.replace(F.replace(F.concat(F.lit("# "), "text"), F.lit("\n"), part), F.lit(". "), F.lit(".\n"))
    chunks = CH.markdown_chunks(rows.withColumn("text", text), "doc_id")
    return chunks.select("doc_id", "index", "label", F.length("text").alias("length"), F.sha2("text", 256).alias("digest"))


@query("""SELECT doc_id, len(list_distinct(list_filter(string_split(text, ' '), lambda w: w <> ''))) AS words,
  sha256(array_to_string(list_sort(list_distinct(list_filter(string_split(text, ' '), lambda w: w <> ''))), ' ')) AS digest FROM documents""")
def distinct_words(spark, folder):
    """Distinct words of every document (first-seen order inside, sorted for comparison)."""
    words = T.ordered_distinct(F.split("text", " "))
    rows = V.heavy_table(spark, folder, "documents", "doc_id").withColumn("_w", words)
    return rows.select("doc_id", F.size("_w").alias("words"), F.sha2(F.array_join(F.array_sort("_w"), " "), 256).alias("digest"))


@query("""SELECT doc_id, sha256(replace(replace('| ' || text || ' |', '|', '\\|'), chr(10), ' ')) AS digest FROM documents""")
def markdown_escape(spark, folder):
    """Documents as Markdown table cells."""
    cell = T.escape_markdown(F.concat(F.lit("| "), "text", F.lit(" |")))
    return V.table(spark, folder, "documents").select("doc_id", F.sha2(cell, 256).alias("digest"))


@query(f"WITH {V.DOCUMENT_PAGES_SQL} SELECT doc_id, structural_tier, strategic_score, quality_score AS evidence_score, combined_score FROM combined")
def selection_score(spark, folder):
    """Tier and scores every page is ranked by."""
    return selection_scores(V.document_pages(spark, folder)).select(
        "doc_id", "structural_tier", "strategic_score", "evidence_score", "combined_score")


def selection(spark, folder):
    scored = selection_scores(V.document_pages(spark, folder))
    return select_for_analysis(scored, V.PICKS, V.BUDGET, window=40)


@query(f"WITH RECURSIVE {V.SELECTION_SQL} SELECT doc_id, site, selected, reason FROM selection")
def budget_selection(spark, folder):
    """Pages chosen per site under a page and character budget."""
    return selection(spark, folder).select("doc_id", "site", "selected", F.col("analysis_exclusion_reason").alias("reason"))


_BATCH_SQL = V.SELECTION_SQL + """,
 chosen AS (SELECT site, doc_id, url, page_id, text, chars, row_number() OVER (PARTITION BY site ORDER BY rn) AS pos FROM selection WHERE selected),
 packing(site, pos, doc_id, batch, pages, total) AS (SELECT site, pos, doc_id, 0, 1, chars FROM chosen WHERE pos = 1
   UNION ALL SELECT c.site, c.pos, c.doc_id, CASE WHEN p.pages >= 5 OR p.total + c.chars > 6000 THEN p.batch + 1 ELSE p.batch END,
     CASE WHEN p.pages >= 5 OR p.total + c.chars > 6000 THEN 1 ELSE p.pages + 1 END,
     CASE WHEN p.pages >= 5 OR p.total + c.chars > 6000 THEN c.chars ELSE p.total + c.chars END
   FROM packing p JOIN chosen c ON c.site = p.site AND c.pos = p.pos + 1)
"""


@query(f"WITH RECURSIVE {_BATCH_SQL} SELECT site, doc_id, batch AS batch_id FROM packing")
def batch_packing(spark, folder):
    """Evaluator batches of the selected pages: at most five pages and 6000 characters."""
    return pack_batches(ranked(selection(spark, folder)), ["analysis_rank"], 5, 6000).select("site", "doc_id", "batch_id")


@query(f"""WITH RECURSIVE {_BATCH_SQL}, first AS (SELECT min_by(text, item_id) AS excerpt FROM benchmark)
  SELECT c.page_id, CASE WHEN contains(c.text, f.excerpt) THEN 'aligned' ELSE 'conflict' END AS status FROM chosen c, first f""")
def page_evaluation(spark, folder):
    """Selected pages evaluated in batches by the rule-based evaluator against one message."""
    excerpt = V.table(spark, folder, "benchmark").agg(F.min_by("text", "item_id")).first()[0]
    messages = [{"message_id": "msg_first", "source_excerpt": excerpt}]
    chosen = ranked(selection(spark, folder)).withColumns({
        "sections": F.array(F.struct(F.col("title").alias("heading"), F.lit("p").alias("element"), F.col("text").alias("text"))),
        "meta_description": F.lit(""), "headings": F.array(F.col("title")), "breadcrumbs": F.array().cast("array<string>"),
        "partial_coverage": F.lit(False),
    })
    batches = pack_batches(chosen, ["analysis_rank"], 5, 6000).withColumn("page", R.evaluator_input())
    done = evaluate_batches(batches, RuleEvaluator(), messages)
    return done.select("page_id", F.col("evaluation.status").alias("status"))


# Evaluations of labelled documents quote their page and a benchmark message; where the label says
# low quality the page excerpt is changed, where it says toxic the message excerpt is, and every
# seventh document names a message that does not exist.
_CLAIMS_SQL = """
 model AS (SELECT 'msg_' || item_id AS message_id, text AS source_excerpt FROM benchmark), size AS (SELECT count(*) AS n FROM benchmark),
 claims AS (SELECT d.doc_id, 'page_' || d.doc_id AS page_id, CASE WHEN quality = 0 THEN '~' ELSE '' END || substr(d.text, 1 + d.doc_id % 50, 60) AS current_excerpt,
   CASE WHEN d.doc_id % 7 = 0 THEN 'msg_x' || d.doc_id ELSE 'msg_' || (d.doc_id % s.n) END AS message_id,
   toxic = 1 AS changed, d.text FROM documents d JOIN labels l ON l.doc_id = d.doc_id, size s)
"""


def claims(spark, folder):
    documents, labels = V.table(spark, folder, "documents"), V.table(spark, folder, "labels")
    n = V.table(spark, folder, "benchmark").count()
    excerpt = F.concat(F.when(F.col("quality") == 0, "~").otherwise(""), F.expr("substr(text, 1 + cast(doc_id % 50 as int), 60)"))
    message = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("msg_x"), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.lit("msg_"), (F.col("doc_id") % n).cast("string")))
    return documents.join(labels, "doc_id").select(
        "doc_id", F.concat(F.lit("page_"), F.col("doc_id").cast("string")).alias("page_id"), F.lit(0).alias("section"),
        excerpt.alias("current_excerpt"), F.array(message).alias("message_ids"), (F.col("toxic") == 1).alias("changed"))


@query(f"WITH {_CLAIMS_SQL} SELECT page_id, current_excerpt, contains(text, current_excerpt) AS verbatim FROM claims")
def excerpt_provenance(spark, folder):
    """Whether each evaluation quotes its page word for word."""
    texts = V.document_pages(spark, folder).select("page_id", "text")
    return VA.check_page_excerpts(claims(spark, folder), texts).select("page_id", "current_excerpt", "verbatim")


@query(f"WITH {_CLAIMS_SQL} SELECT page_id, message_id FROM claims WHERE message_id NOT IN (SELECT message_id FROM model)")
def unknown_reference_anti(spark, folder):
    """Messages that evaluations name and the model does not have."""
    messages = V.table(spark, folder, "benchmark").select(F.concat(F.lit("msg_"), F.col("item_id").cast("string")).alias("message_id"))
    return VA.unknown_message_ids(claims(spark, folder), messages).select("page_id", "message_id")


@query(f"""WITH {_CLAIMS_SQL}, given AS (SELECT page_id, doc_id, current_excerpt, message_id, text, toxic = 1 AS twice FROM claims JOIN labels USING (doc_id))
  SELECT page_id AS key, 'INVALID_PROVIDER_RESPONSE' AS code, 'Provider returned an unknown or duplicate page ID.' AS message FROM given WHERE twice
  UNION ALL SELECT 'page_' || doc_id, 'INVALID_PROVIDER_RESPONSE', 'Provider did not return exactly one evaluation for every supplied page.'
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM given)
  UNION ALL SELECT page_id, 'INVALID_PROVIDER_PROVENANCE', 'Page excerpt for ' || page_id || ' is not verbatim.' FROM given WHERE current_excerpt <> '' AND NOT contains(text, current_excerpt)
  UNION ALL SELECT page_id, 'INVALID_PROVIDER_PROVENANCE', 'Evaluation for ' || page_id || ' references an unknown message ID.' FROM given
    WHERE message_id NOT IN (SELECT message_id FROM model)""")
def batch_contract(spark, folder):
    """All rules that evaluations break, in one pass: those of toxic documents come twice, unlabelled documents have none."""
    section = F.struct(F.lit("h").alias("heading"), "current_excerpt", "message_ids", F.lit("").alias("message_excerpt"),
                       F.lit("change").alias("action"), F.lit("g").alias("guidance"))
    valid = {"page_type": F.lit("other"), "status": F.lit("conflict"), "confidence": F.lit("high"),
             **{c: F.lit(1.0) for c in VA.CHECKED if c not in ("page_type", "status", "confidence", "affected_sections")}}
    rows = claims(spark, folder).withColumn("affected_sections", F.array(section)).withColumns(valid)
    times = F.when(F.col("changed"), 2).otherwise(1)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select("page_id", *VA.CHECKED)
    texts = V.table(spark, folder, "documents").select(
        F.concat(F.lit("page_"), F.col("doc_id").cast("string")).alias("page_id"), F.array(F.struct(F.col("text"))).alias("sections"))
    messages = V.table(spark, folder, "benchmark").select(
        F.concat(F.lit("msg_"), F.col("item_id").cast("string")).alias("message_id"), F.col("text").alias("source_excerpt"))
    return VA.evaluation_violations(rows, texts, messages)


@query("""WITH located AS (SELECT 'msg_' || doc_id AS message_id, doc_id, string_split(text, chr(10)) AS ls, quality FROM documents JOIN labels USING (doc_id))
  SELECT message_id AS key, 'INVALID_PROVIDER_PROVENANCE' AS code FROM located WHERE quality = 0 AND NOT contains(ls[1], '~' || ls[1])""")
def message_provenance(spark, folder):
    """Messages of labelled documents whose excerpt is not in the chunk they name."""
    documents = V.table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("_at", "text"))
    chunks = documents.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("kind"), (F.col("_at") + 1).alias("index"),
                              F.lit("line").alias("label"), "text")
    first = V.table(spark, folder, "documents").join(V.table(spark, folder, "labels"), "doc_id")
    line = F.split("text", "\n")[0]
    messages = first.select(
        F.concat(F.lit("msg_"), F.col("doc_id").cast("string")).alias("message_id"), F.lit("other").alias("category"),
        F.when(F.col("quality") == 0, F.concat(F.lit("~"), line)).otherwise(line).alias("source_excerpt"),
        F.struct(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("kind"), F.lit(1).alias("index"), F.lit("line").alias("label")).alias("source_location"))
    return VA.message_violations(messages, chunks).select("key", "code")


@query("""WITH pages AS (SELECT source AS site, doc_id, min(doc_id) OVER (PARTITION BY source, text) AS owner, n_chars > 5000 AS partial FROM documents)
  SELECT site, count(*) AS discovered, count(*) AS fetched, count(*) FILTER (doc_id = owner) AS rendered,
   0::BIGINT AS analyzed, 0::BIGINT AS excluded, 0::BIGINT AS failed, count(*) FILTER (doc_id <> owner) AS duplicate,
   count(*) FILTER (partial) AS partial FROM pages GROUP BY site""")
def inventory_summary(spark, folder):
    """Counts per site over documents as pages, with duplicates inside a site."""
    documents = V.table(spark, folder, "documents").select("doc_id", "n_chars")
    pages = V.document_pages(spark, folder).join(documents, "doc_id").withColumn("partial_coverage", F.col("n_chars") > 5000)
    return I.inventory_summary(I.inventory_rows(I.mark_duplicates(pages)))


@query("""SELECT source AS document_id, count(*) AS chunks, sum(length(text))::BIGINT AS character_count FROM documents GROUP BY source""")
def chunk_totals(spark, folder):
    """Chunks and characters per source."""
    return CH.chunk_totals(V.table(spark, folder, "documents").withColumn("document_id", F.col("source")))
