"""Building and repairing evaluation sets, blind assignment, resuming, and summaries over collections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import question_text, strip, tokenize, word_set
from siftwell.functions.verdicts import in_range
from siftwell.operators.metrics import rate
from siftwell.operators.order import numbered, numbered_by
from siftwell.operators.retrieval import ranked, vector_topk
from siftwell.session import ship

#: Least characters of questions and answers of the two prefilters, similarity threshold and gold chunks of a question.
CURATE = (40, 100)
BUILD = (40, 120)
TAU, GOLD = 0.62, 3


def qa_pairs(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> (conv_id, turn, question, answer): a user's turn and the assistant's that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumns({"_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return rows.filter("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def prefilter_curate(qa: DataFrame) -> DataFrame:
    """By the unstripped lengths of title and question with a blank between, and of the answer."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("question", F.lit("")))
    return qa.filter((F.length(text) >= CURATE[0]) & (F.length("answer") >= CURATE[1]))


def prefilter_build(qa: DataFrame) -> DataFrame:
    """By the stripped lengths of title and question with a blank line between, and of the answer."""
    return qa.filter((F.length(question_text(F.col("title"), F.col("question"))) >= BUILD[0]) & (F.length(strip(F.col("answer"))) >= BUILD[1]))


def is_substantive(text: Column) -> Column:
    """300 to 2000 characters, over 40 blanks and under 60 line ends."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return F.length(text).between(300, 2000) & (count(" ") > 40) & (count("\n") < 60)


def head(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in an order that is said."""
    return rows.orderBy(order).limit(n)


def systematic_sample(rows: DataFrame, m: int, order: str) -> DataFrame:
    """Every step-th row in an order, step = max(1, n div m), and the first m of those. Only keys are numbered; rows are joined back by key."""
    step = max(1, rows.count() // m) if m else 1
    picked = numbered(rows.select(order), order, "_at").filter((F.col("_at") % step == 0) & (F.col("_at") < step * m)).select(order)
    return rows.join(picked, order, "left_semi").orderBy(order).limit(m)


def systematic_sample_by(rows: DataFrame, m: int, group: str, order: str) -> DataFrame:
    """The same within each group."""
    at = numbered_by(rows.select(group, order), group, order, "_at", "_size").withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_size") / m)))
    picked = at.filter((F.col("_at") % F.col("_step") == 0) & (F.col("_at") < F.col("_step") * m)).select(group, order)
    return rows.join(picked, [group, order], "left_semi")


def ab_assignment(key: Column) -> Column:
    """True where the sha256 of a key is even: the base answer is then shown as A."""
    return F.conv(F.right(F.sha2(key.cast("binary"), 256), F.lit(1)), 16, 10).cast("int") % 2 == 0


def ab_unswap(rows: DataFrame) -> DataFrame:
    """``rows(base_is_a, a_score, b_score, a_correct, b_correct, preferred)`` -> base_* and rag_* columns and who was preferred; values of
    ``preferred`` other than A and B stay."""
    pick = lambda x, y: F.when(F.col("base_is_a"), F.col(x)).otherwise(F.col(y))
    side = F.when(F.col("preferred") == "A", F.when(F.col("base_is_a"), "base").otherwise("rag")).when(F.col("preferred") == "B", F.when(F.col("base_is_a"), "rag").otherwise("base")).otherwise(F.col("preferred"))
    new = {"base_score": pick("a_score", "b_score"), "rag_score": pick("b_score", "a_score"), "base_correct": pick("a_correct", "b_correct"), "rag_correct": pick("b_correct", "a_correct"), "preferred": side}
    return rows.withColumns(new).drop("a_score", "b_score", "a_correct", "b_correct")


def eval_set_by_similarity(answers: DataFrame, chunks: DataFrame, tau: float = TAU, most: int = GOLD, own: bool = False) -> DataFrame:
    """``answers(query_id, vector)``, ``chunks(chunk_id, vector)`` -> (query_id, gold_chunk_ids, gold_top_sim): the ``most`` nearest chunks
    with a cosine of ``tau`` or more; questions without one are left out. ``own``: the answers are among the chunks, by id, and none is
    gold of itself."""
    top = vector_topk(chunks, answers, most + 1 if own else most)
    if own:
        top = ranked(top.filter("query_id <> chunk_id"), most)
    top = top.filter(F.col("score") >= tau)
    gold = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])
    return top.groupBy("query_id").agg(gold.alias("gold_chunk_ids"), F.max("score").alias("gold_top_sim"))


#: Bytes of passages that travel to the corpus at a time.
PASSAGE_BYTES = 8 << 20


def holders(passages: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the chunks ``corpus(chunk_id, content)`` that hold a whole passage of ``passages(query_id, passage)`` as it is written; an empty passage is held
    by none. Up to PASSAGE_BYTES of passages are looked for in one pass over the corpus by an automaton of all of them, so no text is shuffled. More of them meet
    it by words: all words of a passage but its first and last are whole words of whatever holds it, so chunks meet passages by the longest of these, by ids alone; texts
    are fetched for the pairs that meet. Passages of under three words have no such word: they are looked for by automatons of PASSAGE_BYTES at a
    time."""
    inner = F.expr("transform(slice(w, 2, greatest(size(w) - 2, 0)), x -> struct(length(x) as n, x as x))")
    bytes_of = F.coalesce(F.sum(F.octet_length("passage") + 16), F.lit(0))
    written = passages.filter("passage <> ''").select("query_id", "passage")
    if written.agg(bytes_of).first()[0] <= PASSAGE_BYTES:
        return _search(written.toArrow(), corpus).distinct()
    asked = written.withColumn("w", tokenize(F.col("passage"))).withColumn("anchor", F.array_max(inner)["x"]).drop("w")
    words = corpus.select("chunk_id", F.explode(word_set(F.col("content"))).alias("anchor"))
    met = words.join(asked.filter("anchor is not null").select("query_id", "anchor"), "anchor").select("query_id", "chunk_id").distinct()
    whole = met.join(asked.select("query_id", "passage"), "query_id").join(corpus.select("chunk_id", "content"), "chunk_id")
    out = whole.filter(F.contains("content", "passage")).select("query_id", "chunk_id")
    short = asked.filter("anchor is null").select("query_id", "passage")
    size = short.agg(bytes_of).first()[0]
    blocks = -(-size // PASSAGE_BYTES)
    for i in range(blocks):
        part = short.filter(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == i).toArrow()
        out = out.unionByName(_search(part, corpus))
    return out.distinct()


def _search(passages: pa.Table, corpus: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the chunks that hold one of a block of passages. Bytes are compared, a letter each, as ``contains`` does: no text need be valid UTF-8."""
    letters = lambda text: text.decode("latin-1")
    ids, given = passages.column(0).combine_chunks(), passages.column(1).cast(pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, of = ahocorasick.Automaton(), {}
        for k, passage in enumerate(given.to_pylist()):
            of.setdefault(letters(passage), []).append(k)
        for passage in of:
            automaton.add_word(passage, passage)
        automaton.make_automaton()
        for batch in batches:
            row, which = [], []
            for i, content in enumerate(batch.column(1).to_pylist()):
                for passage in {p for _, p in automaton.iter(letters(content or b""))}:
                    row += [i] * len(of[passage])
                    which += of[passage]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), batch.column(0).take(pa.array(row, pa.int64()))], ["query_id", "chunk_id"])

    ship(corpus.sparkSession)
    name = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}[ids.type]
    return corpus.select("chunk_id", F.col("content").cast("binary").alias("content")).mapInArrow(run, f"query_id {name}, chunk_id {dict(corpus.dtypes)['chunk_id']}")


def curated(verdicts: DataFrame, pool: DataFrame) -> DataFrame:
    """``verdicts(query_id, keep, gold_indices)`` over ``pool(query_id, chunk_id, position)`` -> (query_id, gold_chunk_ids) of the
    questions that are kept and name one candidate at least."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda x: x["chunk_id"])
    pools = pool.groupBy("query_id").agg(ids.alias("ids"))
    rows = verdicts.filter("keep").join(pools, "query_id").withColumn("at", in_range(F.col("gold_indices"), F.size("ids")))
    return rows.filter(F.size("at") > 0).select("query_id", F.transform("at", lambda i: F.get("ids", i)).alias("gold_chunk_ids"))


def usable_synthetic(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("usable") & (F.length("question") > 0) & (F.length("reference") > 0))


def remap_gold(questions: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Gold of one chunking on another: ``questions(query_id, gold_chunk_ids)``, chunks ``(chunk_id, doc_path, chunk_index, content)`` ->
    (query_id, gold_chunk_ids, gold_chunk_ids_orig). An old chunk goes to the chunk of its document that holds the largest share of its
    words, the first of equals; ids repeat once, in order; questions left without gold go. A chunk without words counts its path as one."""
    words = lambda c: F.when(F.size(word_set(c)) > 0, word_set(c)).otherwise(F.array(F.lower("doc_path")))
    was = questions.select("query_id", F.posexplode("gold_chunk_ids").alias("place", "chunk_id")).join(old, "chunk_id").select("query_id", "place", "doc_path", words(F.col("content")).alias("was"))
    now = new.select("doc_path", F.col("chunk_id").alias("to"), "chunk_index", words(F.col("content")).alias("now"))
    share = F.size(F.array_intersect("was", "now")) / F.size("was")
    pairs = was.join(now, "doc_path").select("query_id", "place", "to", "chunk_index", share.alias("share"))
    w = Window.partitionBy("query_id", "place").orderBy(F.desc("share"), "chunk_index")
    best = pairs.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    gold = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "to"))), lambda x: x["to"]))
    mapped = best.groupBy("query_id").agg(gold.alias("_gold"))
    return questions.join(mapped, "query_id").select("query_id", F.col("_gold").alias("gold_chunk_ids"), F.col("gold_chunk_ids").alias("gold_chunk_ids_orig"))


def to_rerun(prior: DataFrame, questions: DataFrame, key: str = "id") -> DataFrame:
    """Questions without a row that has both scores."""
    valid = prior.filter("base_score is not null and rag_score is not null").select(key)
    return questions.join(valid, key, "left_anti")


def resume_merge(prior: DataFrame, rerun: DataFrame, key: str = "id") -> DataFrame:
    """``prior`` with the rows that were run again in their place; ids that ``prior`` lacks are not added."""
    again = rerun.select(key, F.struct(*[c for c in prior.columns if c != key]).alias("_new"))
    rows = prior.join(again, key, "left")
    return rows.select(key, *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in prior.columns if c != key])


def selection_rank(rows: DataFrame) -> DataFrame:
    """``rows(candidate, docs_answerable, base_score)`` -> candidate, sampled, docs_answerable, base_mean_score, position: least familiar
    first (0 is a mean like another), candidates without a mean last."""
    good = F.col("docs_answerable") & F.col("base_score").isNotNull()
    out = rows.groupBy("candidate").agg(F.count("*").alias("sampled"), F.count_if(good).alias("docs_answerable"), F.round(F.avg(F.when(good, F.col("base_score"))), 1).alias("base_mean_score"))
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.asc_nulls_last("base_mean_score"), "candidate")))


def cross_repo_summary(repos: DataFrame, probe: DataFrame, coverage: DataFrame, recall: DataFrame, ablation: DataFrame) -> DataFrame:
    """One row per collection from results that may each be missing. Familiarity comes from the probe for a forum that has one, else from
    the ablation's base mean."""
    out = repos.join(probe, "repo", "left").join(coverage, "repo", "left").join(recall, "repo", "left").join(ablation, "repo", "left")
    familiar = F.when((F.col("eval_mode") == "forum") & F.col("probe_mean").isNotNull(), F.col("probe_mean")).otherwise(F.col("base_mean_score"))
    wtl = F.when(F.col("rag_wins").isNotNull(), F.concat_ws("/", "rag_wins", "ties", "rag_losses"))
    return out.select("repo", "eval_mode", F.round(familiar, 1).alias("base_familiarity"), "claim_coverage_at5", "corpus_gap", "recall_at5", F.col("mean_lift").alias("fallback_lift"), wtl.alias("fallback_wtl"))


def gold_hit_rate(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of questions whose retrieved ids and gold ids overlap: ``retrieved(query_id, ids)``, ``gold(query_id, gold_ids)``."""
    return gold.join(retrieved, "query_id", "left").agg(F.count("*").alias("n"), F.round(rate(F.arrays_overlap("ids", "gold_ids")), 3).alias("hit_rate"))
