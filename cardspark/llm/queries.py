"""The registered queries of this package, under the contracts' column names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import alignment, bpe, jaccard, katz, line_dedup, mixing, neighbours, quality, repeats, runs, simhash, toxicity, url_rules
from .common import table


def op1_katz(spark, sf_dir):
    return katz.score(table(spark, sf_dir, "documents"), rereadable=True)


def op2_url_rules(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "_url.*")


def op3_simhash(spark, sf_dir):
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex16(F.col("f0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mix_sources(spark, sf_dir):
    return mixing.shares(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_line_dedup(spark, sf_dir):
    rows = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.kept_text", 256).alias("kept_sha256"))


def op7_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 20 = 0"))


def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0")
    return quality.quality_rules(docs, trusted).select("doc_id", "_q.*")


def op9_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), path))


def op10_repeats(spark, sf_dir):
    """Beside the contract's columns n_short, the bytes in strings of repeats.SHORT bytes that start elsewhere too (passages of some 50 words, which may be too short to be removed), and repeats: 1 if there are any."""
    rows = repeats.remove_spans(repeats.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), short=repeats.SHORT))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return rows.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), total("_spans").alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"), total("_short").alias("n_short"), (F.size("_short") > 0).cast("int").alias("repeats"),
    )


def op11_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), shingle=3, similarity=0.9)


def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.digests(runs.periodic_runs(docs.withColumn("text", runs.with_planted_runs(F.col("doc_id"), F.col("text")))))


def op13_alignment(spark, sf_dir):
    path = public_tokenizers.path
    return alignment.align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_katz, op2_url_rules, op3_simhash, op4_toxicity, op5_mix_sources, op6_line_dedup, op7_neighbours, op8_quality_rules, op9_bpe, op10_repeats, op11_jaccard_join, op12_periodic_runs, op13_alignment)}

_W = r"'[^\x20\x09-\x0D]+'"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_SOME = r"[^\x20\x09-\x0D]+"


def _seats(name: str, parties: str, columns: str, group: str, votes: str, seats: str, key: str, out: str) -> str:
    """CTEs of the Sainte-Laguë seats of each party; columns: those that go on."""
    over = f"over (partition by {group})" if group else "over ()"
    return f"""{name}1 as (select *, sum({votes}) {over} as sum_, count(*) {over} as n_ from {parties}),
{name}2 as (select *, case when sum_ > 0 then {votes} / sum_ else 0 end as share_, ceil(case when sum_ > 0 then {votes} / sum_ else 0 end * n_ / 2) + 2 as half_ from {name}1),
{name}3 as (select *, greatest(0, floor(share_ * {seats}) - half_) as base_ from {name}2),
{name}4 as (select *, {seats} - sum(base_) {over} as more_ from {name}3),
{name}5 as (select *, unnest(range(cast(base_ as bigint), cast(base_ + 2 * half_ as bigint) + 1)) as k_ from {name}4),
{name}6 as (select *, row_number() over ({f"partition by {group}" if group else ""} order by {votes} / (2 * k_ + 1.0) desc, {votes} desc, {key} nulls last, k_) <= more_ and {votes} > 0 as won_ from {name}5),
{name} as (select {columns}, cast(min(base_) + count(*) filter (won_) as bigint) as {out} from {name}6 group by {columns})"""


def _draw(kind: str) -> str:
    return f"cast('0x' || substr(md5('{mixing.SEED}:{kind}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint)"


_MIX = f"""
with d as (select doc_id, source as s, cast(len(regexp_extract_all(coalesce(text, ''), '{_SOME}')) as bigint) as size from documents),
z as (select s, cast(sum(size) as bigint) as source_size from d group by s),
w as (select *, cast(case (row_number() over (order by s nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as double) as w, source_size * 3.0 as cap from z),
f as (select *, (sum(source_size) over () - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level from w window b as (order by cap / w, s nulls last rows between unbounded preceding and 1 preceding)),
t as (select s, source_size, cast(case when cap <= level * w then cap else (select level from f where cap > level * w order by cap / w, level limit 1) * w end as double) as target, cast(round(sum(source_size) over () / {mixing.BLOCK}.0) as bigint) as seats from f),
{_seats("p", "t", "s, source_size, target, seats", "", "target", "seats", "s", "blocks")},
r as (select doc_id, size, d.s, source_size, target, blocks, {_draw("shard")} % greatest(1, cast(ceil(source_size / {mixing.SHARD}.0) as bigint)) as shard from d join p on d.s is not distinct from p.s),
h as (select s, source_size, blocks, shard, cast(sum(size) as bigint) as shard_size from r group by s, source_size, blocks, shard),
{_seats("q", "h", "s, shard, shard_size, blocks", "s", "shard_size", "blocks", "shard", "quota")},
x as (select r.*, shard_size, least(quota * {mixing.BLOCK}, shard_size * {mixing.MAX_REPEAT}) as words, sum(size) over (partition by r.s, r.shard order by {_draw("order")}, doc_id rows unbounded preceding) - size as before from r join q on r.s is not distinct from q.s and r.shard = q.shard),
y as (select *, case when shard_size > 0 then words // shard_size else 0 end as rounds from x)
select doc_id, size, source_size, target, cast(rounds * size + greatest(0, least(size, words - rounds * shard_size - before)) as bigint) as taken from y"""

ORACLES = {
    "op5_mix_sources": _MIX,
    "op6_line_dedup": rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select doc_id, pos, line, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, max(doc_id) as keep from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select k.doc_id, count(*) as n_lines, count(*) filter (c.keep is not null and c.keep <> k.doc_id) as n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) order by k.pos) filter (c.keep is null or c.keep = k.doc_id), '')) as kept_sha256
from k left join c on k.key = c.key group by k.doc_id""",
}
