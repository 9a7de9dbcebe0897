"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.llm import alignment, chat, decontaminate, exact_dedup, html_text, line_dedup, near_dedup, ngram_lm, pieces, prefix_trie, sharding, surrogates, toxicity
from rastermill.llm.common import fold_of, table

#: Shards and slots of op4.
SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(16)], 4099

#: Key of op7's surrogates; a real one comes from a secret store.
SECRET = "example key"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.language_model_scores(table(spark, sf_dir, "documents"), ngram_lm.held_out_fold())


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_blocks")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    placed = sharding.place(docs, sharding.lookup_table(spark, SHARDS, SLOTS), "doc_id", SLOTS)
    return placed.select("doc_id", "slot", "shard_no", "shard")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.toxicity_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "evidence")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_turns(rows))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_private(table(spark, sf_dir, "documents"), SECRET)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.tokenizer_alignment(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.conversation_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie_nodes(*prefix_trie.share_heads(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_lm_scoring, op2_html_extraction, op3_minhash_near_dedup, op4_sharding, op5_toxicity, op6_chat_formatting, op7_pii_surrogates, op8_decontamination,
        op9_exact_dedup, op10_sentencepiece, op11_line_dedup, op12_tokenizer_alignment, op13_prefix_trie,
    )
    return {f.__name__: f for f in own}


def sharding_sql() -> str:
    """The same table filled by a recursive query, then the placement."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SHARDS))
    h = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE shards(shard_no, shard) AS (VALUES {names}),
pref AS (
  SELECT shard_no, shard, {h.format("'offset:' || shard")} % {SLOTS} AS o, {h.format("'step:' || shard")} % {SLOTS - 1} + 1 AS s FROM shards),
orders AS (
  SELECT shard_no, list((o + j * s) % {SLOTS} ORDER BY j) AS slots FROM pref, range({SLOTS}) r(j) GROUP BY shard_no),
claims(turn, slot, taken) AS (
  SELECT 0, slots[1], [slots[1]] FROM orders WHERE shard_no = 0
  UNION ALL
  SELECT turn + 1, pick, list_append(taken, pick) FROM (
    SELECT c.turn, c.taken, list_filter(o.slots, lambda x: NOT list_contains(c.taken, x))[1] AS pick
    FROM claims c JOIN orders o ON o.shard_no = (c.turn + 1) % {len(SHARDS)} WHERE c.turn + 1 < {SLOTS}))
SELECT d.doc_id, c.slot, s.shard_no::INTEGER AS shard_no, s.shard
FROM documents d JOIN claims c ON c.slot = {h.format("d.doc_id::VARCHAR")} % {SLOTS} JOIN shards s ON s.shard_no = c.turn % {len(SHARDS)}
"""


#: Digests as the contract of op6 states them; what formatting adds is counted by the template's marks.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (
  SELECT *, length(text)
    + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '<s>|<<SYS>>|<</SYS>>|<<ANS>>|\[INST\]|\[/INST\]|</s>|\[ROLE\]|\[/ROLE\]')) AS esc,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 END AS marks,
    lag(role, 1, '') OVER w AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  (3 + sum(esc + marks))::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before = '' WHEN 'user' THEN before <> 'user' WHEN 'assistant' THEN before = 'user' ELSE false END
           AND (back > 1 OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding_sql(), "op6_chat_formatting": CHAT_SQL, "op9_exact_dedup": exact_dedup.SQL, "op11_line_dedup": line_dedup.SQL, "op13_prefix_trie": prefix_trie.SQL}
