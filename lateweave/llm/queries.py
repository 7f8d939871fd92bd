"""The registered queries of this folder and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, langid, media, mixing, packing, quality, simhash, suffix_dedup, tokens
from .common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op3_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and probability of the top grade of every document, learnt from the rated ones."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade")))
    return quality.score(docs, model)


PROBE = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from every formatted conversation and the probe."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    tokenizer = tokens.default_tokenizer()
    return chat.read_back(chat.formatted(turns.union(probe), tokenizer), tokenizer)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text."""
    found = tokens.token_counts(table(spark, sf_dir, "documents"), tokens.default_tokenizer())
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from those not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    found = langid.predict(docs, langid.train(docs.where(~F.col("held_out"))))
    return found.withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every text occurred before."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), tokens.default_tokenizer())


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from every text stored as motion JPEG."""
    return media.payloads(media.media_of(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_fingerprints": op2_fingerprints,
    "op3_quality_ordinal": op3_quality_ordinal,
    "op4_chat_format": op4_chat_format,
    "op5_token_counts": op5_token_counts,
    "op6_language_id": op6_language_id,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_packing": op8_packing,
    "op9_simhash_neardup": op9_simhash_neardup,
    "op10_media_avi": op10_media_avi,
}

_MIXING = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
         md5('42|' || coalesce(doc_id::varchar, 'null') || '|' || md5(coalesce(text, ''))) key
  from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] w from s),
r as (select *, 2.0::double * source_size cap, (2.0::double * source_size) / w ratio from w),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over up, 0))
                / (sum(w) over () - coalesce(sum(w) over up, 0)) lvl
      from r window up as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select coalesce((select lvl from l where lvl <= ratio order by ratio, source nulls last limit 1), 'infinity'::double) x),
t as (select source, source_size, least(cap, x * w)::double target from l, f),
p as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::bigint budget,
         coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size
                                    rows between unbounded preceding and 1 preceding), 0)::bigint before
  from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end epochs from p)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint taken
from e
"""



def _escaped(text: str) -> str:
    sql = f"replace({text}, '{chat.MARK}', '{chat.MARK}0')"
    for c in chat.GUARDED:
        sql = f"replace({sql}, '{c}', '{c[0]}{chat.MARK}1{c[1:]}')"
    return sql


_CHAT = f"""
with t as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'),
e as (select *, length({_escaped("text")}) + case role when 'user' then {len("[INST][/INST]")}
                when 'assistant' then {len("<|assistant|></s>")}
                else {len("<|role|><|text|><|end|>")} + length({_escaped("role")}) end chars from t)
select conv_id, count(*)::bigint n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, md5(text))) turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, md5(text)) filter (role = 'assistant'), '')) loss_sha256,
       (sum(chars) + {len("<s>")})::bigint formatted_chars
from e group by conv_id
"""

ORACLES: dict[str, str] = {"op1_source_mixing": _MIXING, "op4_chat_format": _CHAT}
