"""Scans, filters, projections, cleaning and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.functions import vectors as V
from siftwell.functions import verdicts as J
from siftwell.operators import chunking, evalset, metrics
from siftwell.queries.registry import query, table
from siftwell.sources import code, service

STRIP = "regexp_replace(regexp_replace({0}, '^[\\s\\x{{A0}}\\x{{3000}}]+', ''), '[\\s\\x{{A0}}\\x{{3000}}]+$', '')"


def made_sql(text: str) -> str:
    """Documents whose texts an expression, in words that both engines take, makes into what an operator is for."""
    return f"(SELECT doc_id AS id, {text} AS text FROM documents)"


def made(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(text).alias("text"))


def lines(*parts: str) -> str:
    """An expression of parts, each a line."""
    return " || chr(10) || ".join(parts)


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("doc_path"), "text")


@query("SELECT concat_ws('/', source, doc_id) AS doc_path, length(text)::int AS chars FROM documents WHERE length(text) >= 40")
def scan_documents(spark, sf_dir):
    return docs_of(spark, sf_dir).filter(F.length("text") >= 40).select("doc_path", F.length("text").alias("chars"))


@query("SELECT vec_id, i::int AS dim, round(embedding[i + 1]::double / sqrt(list_sum([x::double * x::double for x in embedding])), 6) AS v FROM embeddings, range(64) AS r(i)")
def normalize_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.normalized(F.col("embedding"))).alias("dim", "v")).withColumn("v", F.round("v", 6))


@query("""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<div class="([^"]*)"', 1) AS class FROM pages""")
def tag_attributes(spark, sf_dir):
    """The attributes of each page's first html and div tags."""
    tag = lambda name: X.attributes(F.regexp_extract("html", f"<{name}([^>]*)>", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.try_element_at(tag("html"), F.lit("lang")).alias("lang"), F.try_element_at(tag("div"), F.lit("class")).alias("class"))


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10")
def head_limit(spark, sf_dir):
    return evalset.head(table(spark, sf_dir, "benchmark"), 10, "item_id")


@query("SELECT source || '__' || lang || CASE WHEN doc_id % 2 = 0 THEN '_mech' ELSE '' END || '#' || doc_id AS id, lang AS tool FROM documents")
def derived_names(spark, sf_dir):
    tool = F.concat(F.col("source"), F.lit("__"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, "_mech").otherwise(""))
    return table(spark, sf_dir, "documents").select(X.derived_id(tool, F.col("doc_id")).alias("id"), X.short_name(tool).alias("tool"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: " + STRIP.format("x") + "), lambda x: x <> ''), '|') AS parts FROM documents")
def split_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.sentences(F.col("text")), "|").alias("parts"))


@query("SELECT page_id, to_base64(encode(url)) AS encoded, url FROM pages")
def base64_round_trip(spark, sf_dir):
    coded = service.encoded(F.col("url").cast("binary"))
    rows = table(spark, sf_dir, "pages").select(F.lit("r").alias("repo"), F.col("page_id").cast("string").alias("path"), coded.alias("content"), F.lit("base64").alias("encoding"))
    back = service.file_bytes(rows).select(F.col("path").cast("long").alias("page_id"), service.encoded(F.col("content")).alias("encoded"), F.col("content").cast("string").alias("url"))
    return back


@query("SELECT vec_id, len(embedding)::int AS dims, label FROM embeddings")
def scan_embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dims"), "label")


@query("SELECT page_id, url FROM pages WHERE (ends_with(url, '.html') OR ends_with(url, '#top')) AND (starts_with(url, 'https://') OR starts_with(url, 'http://www.')) AND NOT list_has_any(string_split(url, '/'), ['tests', 'test', '_tests'])")
def filter_path_prefix(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(X.in_paths(F.col("url"), ["https://", "http://www."], [".html", "#top"])).select("page_id", "url")


@query("SELECT doc_id FROM documents WHERE length(text) >= 400")
def filter_min_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.length("text") >= 400).select("doc_id")


PAIRS = """(SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role,
    lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"""


def pairs(spark, sf_dir):
    return evalset.qa_pairs(table(spark, sf_dir, "conversations"))


@query(f"SELECT * FROM {PAIRS}")
def qa_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


@query(f"SELECT conv_id, turn FROM {PAIRS} WHERE length('' || ' ' || question) >= 40 AND length(answer) >= 100")
def filter_qa_curate(spark, sf_dir):
    return evalset.prefilter_curate(pairs(spark, sf_dir).withColumn("title", F.lit(""))).select("conv_id", "turn")


@query(f"SELECT conv_id, turn FROM {PAIRS} WHERE length({STRIP.format('question')}) >= 40 AND length({STRIP.format('answer')}) >= 120")
def filter_qa_build(spark, sf_dir):
    return evalset.prefilter_build(pairs(spark, sf_dir).withColumn("title", F.lit(""))).select("conv_id", "turn")


@query(f"SELECT conv_id, turn, {STRIP.format(chr(39) + 'Q' + chr(39) + ' || chr(10) || chr(10) || question')} AS text FROM {PAIRS}")
def project_question_text(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", X.question_text(F.lit("Q"), F.col("question")).alias("text"))


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 300 AND 2000 AND length(text) - length(replace(text, ' ', '')) > 40 AND length(text) - length(replace(text, chr(10), '')) < 60")
def filter_substantive(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(evalset.is_substantive(F.col("text"))).select("doc_id")


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || ' …' ELSE text END AS short FROM documents")
def project_shorten(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.shorten(F.col("text"), 500).alias("short"))


@query("SELECT doc_id, greatest(1, length(text) // 4)::int AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ') AS words FROM documents")
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.tokenize(F.col("text")), " ").alias("words"))


@query("""SELECT source, sha256(string_agg(h, '' ORDER BY block))[1:12] AS content_hash FROM (SELECT source, doc_id // 4096 AS block, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL) GROUP BY source""")
def content_hash(spark, sf_dir):
    return X.content_hash(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
    '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS text FROM pages""")
def clean_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.clean_markup(F.col("html")).alias("text"))


#: Closed and unclosed blocks, a rule in the text, and a longer rule.
FRONT_TEXT = f"""CASE doc_id % 4 WHEN 0 THEN {lines("'---'", "'title: ' || source", "'---'", "text")} WHEN 1 THEN {lines("'---'", "text")} WHEN 2 THEN {lines("text", "'---'", "'more'")} ELSE {lines("'------'", "'x'", "'---'", "text")} END"""
FRONT = made_sql(FRONT_TEXT)


@query(f"SELECT id, CASE WHEN starts_with(text, '---') AND instr(substr(text, 4), chr(10) || '---') > 0 THEN substr(text, instr(substr(text, 4), chr(10) || '---') + 7) ELSE text END AS body FROM {FRONT}")
def strip_frontmatter(spark, sf_dir):
    return made(spark, sf_dir, FRONT_TEXT).select("id", X.strip_frontmatter(F.col("text")).alias("body"))


RST_TEXT = lines("':orphan: yes'", "'.. toctree:: x'", "'Title ' || doc_id", "'====='", "''", "''", "''", "''", "text", "CASE WHEN doc_id % 2 = 0 THEN '.. note:: stays' ELSE '.. figure:: gone' END", "':field-name: gone'", "'.. automodule:: a.b'", "'   :members:'", "'plain  '")
RST = made_sql(RST_TEXT)


@query(f"""SELECT id, {STRIP.format("regexp_replace(regexp_replace(regexp_replace(text, '(?m)^:([a-zA-Z0-9_][a-zA-Z0-9_-]*):.*$', '', 'g'), '(?m)^[.][.] (" + X.RST_DIRECTIVES + ")::.*$', '', 'g'), '" + chr(10) + "{3,}', chr(10) || chr(10), 'g')")} AS body FROM {RST}""")
def clean_rst(spark, sf_dir):
    return made(spark, sf_dir, RST_TEXT).select("id", X.clean_rst(F.col("text")).alias("body"))


MDX_TEXT = lines(
    "'---'", "'title: t'", "'---'", "'import A from \"a\";'", "''", "'{/* a'", "'comment */}'", "'<Tabs groupId=\"x\"><TabItem value=\"y\">See <PyObject section=\"s\" module=\"dg\" object=\"asset' || doc_id || '\" /> now.</TabItem></Tabs>'", "''", "''", "''",
    "text || ' <note>Mind</note> <PyObject module=\"only.module\" /> end'",
)
MDX = made_sql(MDX_TEXT)


def mdx_sql() -> str:
    front = f"CASE WHEN starts_with(text, '---') AND instr(substr(text, 4), chr(10) || '---') > 0 THEN substr(text, instr(substr(text, 4), chr(10) || '---') + 7) ELSE text END"
    steps = [("(?s)\\{/\\*.*?\\*/\\}", ""), ("(?m)^import\\s+.*?from\\s+[''\"].*?[''\"];?\\s*$", "")]
    steps += [(f"(?s)<PyObject\\b[^>]*?\\b{a}\\s*=\\s*[\"''{{]([^\"''}}]+)[\"''}}][^>]*?/>", "`\\1`") for a in ("object", "module", "decorator")]
    steps += [("(?s)<PyObject\\b[^>]*?/>", "``"), (f"(?i)<(?:{X.JSX_TAGS})\\b[^>]*>", ""), (f"(?i)</(?:{X.JSX_TAGS})>", "")]
    for pattern, to in steps:
        front = f"regexp_replace({front}, '{pattern}', '{to}', 'g')"
    gap = f"regexp_replace({front}, '{chr(10)}{{3,}}', chr(10) || chr(10), 'g')"
    return f"SELECT id, {STRIP.format(gap)} AS body FROM {MDX}"


@query(mdx_sql())
def clean_mdx(spark, sf_dir):
    return made(spark, sf_dir, MDX_TEXT).select("id", X.clean_mdx(F.col("text")).alias("body"))


@query(f"""SELECT doc_id, chunk_index, content FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, content FROM (
    SELECT doc_id, k, {STRIP.format("substr(s, (k * 680 + 1)::bigint, 800)")} AS content FROM (SELECT doc_id, s, unnest(range(0, greatest(0, ceil((length(s) - 800) / 680.0)::int) + 1)) AS k
    FROM (SELECT doc_id, {STRIP.format('text')} AS s FROM documents))) WHERE content <> '')""")
def chunk_fixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_path"), "text")
    return chunking.chunk_documents(docs).select(F.col("doc_path").cast("long").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), "content")


LINES = """SELECT id, n - 1 AS n, line, sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) % 2 = 1 AS in_fence
    FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {0})"""
#: Text before a heading, a fence with a line like a heading, headings of all levels, and in every third document a fence that is never closed.
MD_TEXT = lines("'before'", "'# One ' || source", "text", "''", "'## Two'", "'```py'", "'# not a heading'", "''", "'code'", "'```'", f"""CASE WHEN doc_id % 3 = 0 THEN {lines("'```'", "'never closed'", "'# inside'")} ELSE {lines("'after'", "'#### four stays'", "'### Three'", "'end'")} END""")
MD = made_sql(MD_TEXT)


def md(spark, sf_dir):
    return made(spark, sf_dir, MD_TEXT).withColumnRenamed("id", "doc_path")


@query("SELECT id AS doc_path, n::int AS line_no, line, in_fence FROM (" + LINES.format(MD) + ")")
def fence_parity(spark, sf_dir):
    return chunking.lines_of(md(spark, sf_dir))


SECTIONS = """WITH l AS ({0}), h AS (SELECT *, NOT in_fence AND regexp_matches(line, '^#{{1,3}}\\s+.*$') AS is_h FROM l),
    s AS (SELECT *, sum(is_h::int) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section_no FROM h)
    SELECT id AS doc_path, section_no::bigint AS section_no, coalesce(max(CASE WHEN is_h THEN trim(regexp_extract(line, '^#+\\s+(.*)$', 1)) END), '') AS heading, STRIPPED AS body
    FROM s GROUP BY id, section_no HAVING body <> ''""".replace("STRIPPED", STRIP.format("string_agg(line, chr(10) ORDER BY n)").replace("{", "{{").replace("}", "}}"))
BLOCKS = """WITH l AS ({0}), m AS (SELECT *, starts_with(ltrim(line), '```') AS mark, NOT in_fence AND NOT starts_with(ltrim(line), '```') AND trim(line) = '' AS blank FROM l),
    b AS (SELECT *, NOT blank AND ((mark AND in_fence) OR coalesce(lag(blank) OVER w, true) OR (lag(mark) OVER w AND NOT lag(in_fence) OVER w)) AS begins FROM m WINDOW w AS (PARTITION BY id ORDER BY n)),
    c AS (SELECT *, sum(begins::int) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) - 1 AS block_no FROM b WHERE NOT blank)
    SELECT id AS doc_path, block_no::bigint AS block_no, string_agg(line, chr(10) ORDER BY n) AS block FROM c GROUP BY id, block_no"""


@query(SECTIONS.format(LINES.format(MD)))
def split_sections(spark, sf_dir):
    return chunking.sections(md(spark, sf_dir))


@query(BLOCKS.format(LINES.format(MD)))
def split_blocks(spark, sf_dir):
    return chunking.blocks(md(spark, sf_dir))


#: A user's events are a document's chunks, every fifth of them a heading too.
HEADS = "SELECT user_id AS doc_path, event_id AS pos, event_type AS heading FROM events WHERE event_id % 5 = 0"
PLACES = "SELECT user_id AS doc_path, 'e' || event_id AS chunk_id, event_id AS pos FROM events WHERE event_id % 3 > 0"


@query(f"SELECT c.doc_path, c.chunk_id, c.pos, coalesce(h.heading, '') AS heading FROM ({PLACES}) c ASOF LEFT JOIN ({HEADS}) h ON c.doc_path = h.doc_path AND c.pos >= h.pos")
def nearest_heading(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_path"), F.col("event_id").alias("pos"), "event_type")
    chunks = e.filter("pos % 3 > 0").select("doc_path", F.concat(F.lit("e"), F.col("pos").cast("string")).alias("chunk_id"), "pos")
    return chunking.nearest_heading(chunks, e.filter("pos % 5 = 0").withColumnRenamed("event_type", "heading"))


def windows_sql(x: str, size: int = 800, step: int = 680) -> str:
    return f"list_filter(list_transform(range(0, greatest(0, ceil((length({x}) - {size}) / {step}.0)::bigint) + 1), lambda k: {STRIP.format(f'substr({x}, (k * {step} + 1)::bigint, {size})')}), lambda c: c <> '')"


def packed_sql(parts: str, source: str, size: int = 800, advance: int = 680) -> str:
    """The fold that packs ``parts``, a list, of each row of ``source(doc_path, s)``."""
    both = "CASE WHEN a.buf = '' THEN e.buf ELSE a.buf || chr(10) || chr(10) || e.buf END"
    flushed = "CASE WHEN a.buf = '' THEN a.done ELSE list_append(a.done, a.buf) END"
    step = f"""CASE WHEN length({both}) <= {size} THEN {{'done': a.done, 'buf': {both}}} WHEN length(e.buf) <= {size} THEN {{'done': {flushed}, 'buf': e.buf}}
        ELSE {{'done': list_concat({flushed}, {windows_sql('e.buf', size, advance)}), 'buf': ''}} END"""
    return f"""WITH src AS ({source}), parts AS (SELECT doc_path, list_filter(list_transform({parts}, lambda x: {STRIP.format('x')}), lambda x: x <> '') AS p FROM src),
    f AS (SELECT doc_path, list_reduce(list_prepend({{'done': []::varchar[], 'buf': ''}}, list_transform(p, lambda x: {{'done': []::varchar[], 'buf': x}})), lambda a, e: {step}) AS r FROM parts),
    c AS (SELECT doc_path, CASE WHEN r.buf = '' THEN r.done ELSE list_append(r.done, r.buf) END AS chunks FROM f)
    SELECT doc_path || '#' || (i - 1) AS chunk_id, doc_path, (i - 1)::int AS chunk_index, chunks[i] AS content, '' AS heading FROM (SELECT doc_path, chunks, unnest(range(1, len(chunks) + 1)) AS i FROM c)"""


SENTENCES = f"string_split(regexp_replace(s, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
BUNDLES = "SELECT (doc_id // 8)::varchar AS doc_path, string_agg(coalesce(text, ''), chr(10) || ' ' || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY ALL"


def bundles(spark, sf_dir):
    """Eight documents as one of as many paragraphs and more, as documents have no blank lines."""
    rows = table(spark, sf_dir, "documents").groupBy((F.expr("doc_id div 8")).cast("string").alias("doc_path"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return rows.agg(F.array_join(texts, "\n \n").alias("text"))


@query(packed_sql(SENTENCES, f"SELECT concat_ws('/', source, doc_id) AS doc_path, {STRIP.format('text')} AS s FROM documents"))
def chunk_sentence(spark, sf_dir):
    return chunking.chunk_documents(docs_of(spark, sf_dir), "sentence")


@query(packed_sql("regexp_split_to_array(s, '\\n\\s*\\n')", f"SELECT doc_path, {STRIP.format('text')} AS s FROM ({BUNDLES})"))
def chunk_paragraph(spark, sf_dir):
    return chunking.chunk_documents(bundles(spark, sf_dir), "paragraph")


#: A conversation as a page: a heading for each turn, every fifth text in a code fence that opens with a line like a heading.
PAGES = """(SELECT conv_id AS id, string_agg(CASE WHEN turn % 4 = 3 THEN '#### ' ELSE repeat('#', (turn % 3 + 1)::int) || ' ' END || 'Turn ' || turn || ' of the ' || role || chr(10) || chr(10)
    || CASE WHEN turn % 5 = 2 THEN '```' || chr(10) || '# no heading' || chr(10) || chr(10) || text || chr(10) || '```' ELSE replace(text, '. ', '.' || chr(10) || chr(10)) END, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


def conversation_pages(spark, sf_dir):
    level = F.when(F.col("turn") % 4 == 3, F.lit("#### ")).otherwise(F.concat(F.expr("repeat('#', cast(turn % 3 + 1 as int))"), F.lit(" ")))
    fence = F.concat(F.lit("```\n# no heading\n\n"), F.col("text"), F.lit("\n```"))
    body = F.when(F.col("turn") % 5 == 2, fence).otherwise(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n")))
    part = F.concat(level, F.lit("Turn "), F.col("turn").cast("string"), F.lit(" of the "), F.col("role"), F.lit("\n\n"), body)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"])
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_path")).agg(F.array_join(parts, "\n\n").alias("text"))


@query(f"SELECT id AS doc_path, n::int AS line_no, line, in_fence FROM ({LINES.format(PAGES)})")
def fence_parity_pages(spark, sf_dir):
    return chunking.lines_of(conversation_pages(spark, sf_dir))


@query(SECTIONS.format(LINES.format(PAGES)))
def split_sections_pages(spark, sf_dir):
    return chunking.sections(conversation_pages(spark, sf_dir))


@query(BLOCKS.format(LINES.format(PAGES)))
def split_blocks_pages(spark, sf_dir):
    return chunking.blocks(conversation_pages(spark, sf_dir))


@query(f"""WITH RECURSIVE pages AS (SELECT id::varchar AS id, text, {STRIP.format('text')} AS s FROM {PAGES}), parts AS (SELECT id, text, {windows_sql('s')} AS c FROM pages),
    walk AS (SELECT id, text, c, 0 AS i, 1::bigint AS start, 0::bigint AS pos FROM parts UNION ALL
        SELECT id, text, c, i + 1, CASE WHEN strpos(substr(text, start), left(c[i + 1], 40)) > 0 THEN start + strpos(substr(text, start), left(c[i + 1], 40)) - 1 ELSE start END,
        CASE WHEN strpos(substr(text, start), left(c[i + 1], 40)) > 0 THEN start + strpos(substr(text, start), left(c[i + 1], 40)) - 1 END FROM walk WHERE i < len(c)),
    heads AS (SELECT id, pos, trim(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 2)) AS title FROM (SELECT id, line, 1 + coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
        FROM (SELECT id::varchar AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {PAGES})) WHERE regexp_matches(line, '^#{{1,6}}\\s+.*$'))
    SELECT w.id || '#' || (i - 1) AS chunk_id, w.id AS doc_path, (i - 1)::int AS chunk_index, w.c[i] AS content, coalesce((SELECT arg_max(h.title, h.pos) FROM heads h WHERE h.id = w.id AND h.pos <= w.pos), '') AS heading FROM walk w WHERE i > 0""")
def chunk_headings(spark, sf_dir):
    """Fixed chunks of whole conversations under the headings that they begin in."""
    return chunking.chunk_documents(conversation_pages(spark, sf_dir), headings=True)


@query()
def chunk_markdown(spark, sf_dir):
    return chunking.chunk_markdown(docs_of(spark, sf_dir))


def markdown_sql(pages: str) -> str:
    """Sections, their blocks packed under the section's heading, and neighbours joined: two folds, one inside the other. Cutting of parts over 2,200 characters, which no turn is as
    long as, is left out."""
    full = "(a.buf <> '' AND length(a.buf) + 2 + length(e.buf) > 1100)"
    done = f"CASE WHEN {full} THEN list_append(a.done, {STRIP.format('prefix || a.buf')}) ELSE a.done END"
    buf = f"CASE WHEN {full} OR a.buf = '' THEN e.buf ELSE {STRIP.format('a.buf || chr(10) || chr(10) || e.buf')} END"
    step = f"CASE WHEN length({buf}) > 2200 THEN {{'done': list_append({done}, {STRIP.format(f'prefix || {buf}')}), 'buf': ''}} ELSE {{'done': {done}, 'buf': {buf}}} END"
    return f"""WITH sec AS ({SECTIONS.format(LINES.format(pages))}), src AS (SELECT doc_path::varchar || '|' || section_no AS id, body AS text FROM sec), blk AS ({BLOCKS.format(LINES.format('src'))}),
    lists AS (SELECT s.doc_path, s.section_no, CASE WHEN heading <> '' THEN '## ' || heading || chr(10) ELSE '' END AS prefix, list(block ORDER BY block_no) FILTER ({STRIP.format('block')} <> '') AS blocks FROM sec s JOIN blk b ON b.doc_path = s.doc_path::varchar || '|' || s.section_no GROUP BY ALL),
    packed AS (SELECT doc_path, section_no, prefix, list_reduce(list_prepend({{'done': []::varchar[], 'buf': ''}}, list_transform(blocks, lambda x: {{'done': []::varchar[], 'buf': x}})), lambda a, e: {step}) AS r FROM lists),
    parts AS (SELECT doc_path, flatten(list(CASE WHEN {STRIP.format('r.buf')} <> '' THEN list_append(r.done, {STRIP.format('prefix || r.buf')}) ELSE r.done END ORDER BY section_no)) AS p FROM packed GROUP BY doc_path),
    joined AS (SELECT doc_path, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + 2 + length(x[1]) <= 1100 THEN list_append(a[1:len(a) - 1], a[-1] || chr(10) || chr(10) || x[1]) ELSE list_append(a, x[1]) END) AS c FROM parts WHERE len(p) > 0)
    SELECT doc_path || '#' || (i - 1) AS chunk_id, doc_path::varchar AS doc_path, (i - 1)::int AS chunk_index, {STRIP.format('c[i]')} AS content, trim(regexp_extract(string_split({STRIP.format('c[i]')}, chr(10))[1], '^(#{{1,6}})\\s+(.*)$', 2)) AS heading FROM (SELECT doc_path, c, unnest(range(1, len(c) + 1)) AS i FROM joined)"""


@query(markdown_sql(PAGES))
def chunk_markdown_pages(spark, sf_dir):
    return chunking.chunk_markdown(conversation_pages(spark, sf_dir).withColumn("doc_path", F.col("doc_path").cast("string")))


@query(f"""SELECT doc_path AS id, string_agg(content, '|' ORDER BY chunk_index) AS chunks FROM ({packed_sql("regexp_split_to_array(s, '\\n\\s*\\n')", f"SELECT id AS doc_path, {STRIP.format('text')} AS s FROM {PAGES}", 300, 250).replace("doc_path || '#'", "doc_path::varchar || '#'")}) GROUP BY doc_path""")
def pack_paragraphs(spark, sf_dir):
    """Conversations in chunks of 300 characters, of which longer paragraphs are cut with an overlap of 50."""
    pages = conversation_pages(spark, sf_dir).select("doc_path", X.strip(F.col("text")).alias("text"))
    return pages.select(F.col("doc_path").alias("id"), F.array_join(chunking.chunk_texts(F.col("text"), "paragraph", 300, 50), "|").alias("chunks")).filter("chunks <> ''")


@query("""SELECT count(*) AS n_chunks, median(length(text))::double AS median_chars, max(length(text))::bigint AS max_chars, count(*) FILTER (length(text) < 60) AS tiny_chunks,
    count(*) FILTER (contains(text, 'code example:')) AS stub_chunks, count(DISTINCT concat_ws('/', source, doc_id)) AS n_docs FROM documents""")
def corpus_stats(spark, sf_dir):
    return chunking.corpus_stats(docs_of(spark, sf_dir).withColumnRenamed("text", "content"))


#: A module for each document: its words are the module's documentation.
PY_PATH = "'pkg' || doc_id % 7 || CASE WHEN doc_id % 11 = 0 THEN '/tests' ELSE '' END || '/m' || doc_id || '.py'"
PY_WORDS = "trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' '{0}))"


def py_text(words: str) -> str:
    rows = ["chr(34) || chr(34) || chr(34) || " + words + " || chr(34) || chr(34) || chr(34)", "'def f' || doc_id || '(a, /, b: int = 1, *args, c=2, **kw):'", "'    \"\"\"Does ' || source || '.\"\"\"'", "'def _hidden():'", "'    \"\"\"No.\"\"\"'", "'class K:'", "'    def m(self, x):'"]
    return lines(*rows, "'        \"\"\"Method of ' || lang || '.\"\"\"'", "'    def n(self):'", "CASE WHEN doc_id % 13 = 0 THEN '        pass (' ELSE '        pass' END")


@query(f"""SELECT doc_path, text FROM (SELECT 'api/' || path AS doc_path, CASE WHEN length(w) > 40 THEN '# Module api/' || path || chr(10) || chr(10) || w || chr(10) || chr(10) ELSE '' END || '## f' || doc_id || '(a, b, *args, c, **kw)' || chr(10) || chr(10)
    || 'Does ' || source || '.' || chr(10) || chr(10) || '## class K' || chr(10) || chr(10) || '### K.m(self, x)' || chr(10) || chr(10) || 'Method of ' || lang || '.' AS text
    FROM (SELECT *, {PY_PATH} AS path, {PY_WORDS.format(", 'g'")} AS w FROM documents) WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0) WHERE length(text) > 80""")
def extract_api_docs(spark, sf_dir):
    return code.extract_api_docs(table(spark, sf_dir, "documents").select(F.expr(PY_PATH).alias("path"), F.expr(py_text(PY_WORDS.format(""))).alias("text")))


#: A tag of a region in front of each document; items of the benchmark are the code examples, of which some that are named are not there.
INCLUDING = "'See <CodeExample path=\"x/' || doc_id % 60 || '.py\" startAfter=\"start_a\" endBefore=\"end_a\" /> and ' || coalesce(text, '')"
SNIPPET = lines("'import z'", "'# start_a'", "'    one = ' || item_id", "'      two'", "'# end_a'", "text")


@query("""SELECT doc_id::varchar AS doc_path, 'See ```' || CASE WHEN item_id IS NULL THEN chr(10) || '# (code example: x/' || doc_id % 60 || '.py)' ELSE 'python' || chr(10) || 'one = ' || item_id || chr(10) || '  two' END || chr(10) || '``` and ' || coalesce(documents.text, '') AS text
    FROM documents LEFT JOIN benchmark ON item_id = doc_id % 60""")
def expand_includes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_path"), F.expr(INCLUDING).alias("text"))
    return code.expand_includes(docs, table(spark, sf_dir, "benchmark").select(F.expr("'x/' || item_id || '.py'").alias("path"), F.expr(SNIPPET).alias("text")))


@query("SELECT doc_id, substr(sha256(doc_id::varchar), 64, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS base_is_a FROM documents")
def ab_assignment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evalset.ab_assignment(F.col("doc_id").cast("string")).alias("base_is_a"))


#: Replies of a judge: prose and an object, two objects, none, fields of other types, and numbers out of range.
REPLY = """replace(replace(coalesce(text, ''), '{', '('), '}', ')') || CASE doc_id % 5 WHEN 0 THEN ' Sure: {"a_score": ' || doc_id % 101 || ', "b_score": 20.5, "preferred": "A", "supporting": [0, 7, ' || doc_id % 6 || ', "x"], "ok": true} done' WHEN 1 THEN '{"a": 1} and {"b": 2}'
    WHEN 2 THEN ' no json' WHEN 3 THEN '{"a_score": true, "b_score": "80", "preferred": "tie", "supporting": 3, "ok": "yes"}' ELSE '{"a_score": null, "supporting": [-1, ' || doc_id % 7 || ']}' END"""


@query(f"""WITH r AS (SELECT doc_id AS id, regexp_extract({REPLY}, '(?s)\\{{.*\\}}') AS x FROM documents), o AS (SELECT id, CASE WHEN json_valid(x) THEN x::json END AS j FROM r),
    n AS (SELECT id, j, json_type(j, '$.a_score') AS a, json_type(j, '$.b_score') AS b FROM o)
    SELECT id, CASE WHEN a IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (j->>'$.a_score')::double END AS a_score, CASE WHEN b IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (j->>'$.b_score')::double END AS b_score, CASE WHEN json_type(j, '$.preferred') = 'VARCHAR' THEN j->>'$.preferred' END AS preferred,
    CASE WHEN json_type(j, '$.supporting') = 'ARRAY' THEN array_to_string([y for y in list_transform((j->'$.supporting')::json[], lambda v: CASE WHEN json_type(v) IN ('UBIGINT', 'BIGINT') THEN try_cast(v::varchar AS int) END) if y >= 0 and y < 5], ',') ELSE '' END AS supporting,
    CASE WHEN json_type(j, '$.ok') = 'BOOLEAN' THEN (j->>'$.ok')::boolean END AS ok FROM n""")
def parse_verdicts(spark, sf_dir):
    o = J.reply_object(F.col("reply"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(REPLY).alias("reply"))
    return rows.select("id", J.number(o, "a_score").alias("a_score"), J.number(o, "b_score").alias("b_score"), J.string(o, "preferred").alias("preferred"), F.array_join(J.indices(o, "supporting", 5).cast("array<string>"), ",").alias("supporting"), J.flag(o, "ok").alias("ok"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND quality IS NOT NULL")
def valid_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.filter("toxic is not null and quality is not null").select("doc_id")


@query("SELECT event_id, [x for x in [event_id % 7 - 2, event_id % 5, event_id % 11] if x >= 0 and x < 4] AS kept FROM events")
def array_index_filter(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", J.in_range(F.array(e % 7 - 2, e % 5, e % 11), 4).alias("kept"))


@query("""SELECT doc_id, CASE WHEN a % 3 = 0 THEN 'a_corpus_gap' WHEN a % 9 < 5 THEN 'b_gold_mislabel' WHEN toxic = 1 THEN 'd_embedding' ELSE 'c_chunking' END AS category
    FROM (SELECT doc_id, doc_id * 7 AS a, toxic FROM documents LEFT JOIN labels USING (doc_id))""")
def triage_classify(spark, sf_dir):
    return triaged(spark, sf_dir)


def triaged(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("a", F.col("doc_id") * 7)
    ranks = F.when(F.col("a") % 3 == 0, F.expr("cast(array() as array<bigint>)")).otherwise(F.array(F.col("a") % 9, F.col("a") % 9 + 6))
    return rows.select("doc_id", metrics.triage_category(ranks, F.col("toxic") == 1).alias("category"))


@query("""SELECT category, n, round(100.0::double * n / sum(n) OVER (), 1) AS pct FROM (SELECT CASE WHEN a % 3 = 0 THEN 'a_corpus_gap' WHEN a % 9 < 5 THEN 'b_gold_mislabel' WHEN toxic = 1 THEN 'd_embedding'
    ELSE 'c_chunking' END AS category, count(*) AS n FROM (SELECT doc_id * 7 AS a, toxic FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1)""")
def triage_distribution(spark, sf_dir):
    return metrics.triage_distribution(triaged(spark, sf_dir))


@query("""SELECT item_id, d AS dim, (SELECT coalesce(sum(CASE WHEN ('0x' || substr(md5(w), 1, 1))::int % 2 = 0 THEN 1 ELSE -1 END), 0) FROM (SELECT unnest(words) AS w) WHERE ('0x' || substr(md5(w), 1, 8))::bigint % 32 = d)::int AS v
    FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS words FROM benchmark), range(32) AS r(d)""")
def hash_embed(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(V.hash_embed(X.tokenize(F.col("text")))).alias("dim", "v")).withColumn("dim", F.col("dim").cast("long"))
