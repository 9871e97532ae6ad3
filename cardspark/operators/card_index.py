"""A lexical index of cards that stays (ST5, R1, R2): written once, kept up to date by batches, read by the tokens that are asked.

The index is a folder of Parquet tables. A batch adds a segment: the changed cards with their tokens and vectors, their
postings in blocks, what they change in document frequencies, and tombstones of the versions that they replace or remove. A
manifest of one file, written last, names the segments that count: what is not in it does not exist, so a batch that failed
half way or runs again changes nothing. Many small segments are put together into one.

A block holds the postings of one token among the cards of one part: some PART cards of one scope. Its head has the
largest weighted count and the smallest length in it, so it bounds the score of its cards. A search adds these bounds by
query and part, scores the parts with the best bounds first, and reads only the parts whose bounds reach the k-th score.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import B, FIELDS, K1, WEIGHTS, field_tokens
from .text import content_hash

PART = 256  # cards of one part, about
SEEDS = 4  # parts that a search scores first
PARTS = 32  # parts that are scored in one task at a time
QUERIES = 1024  # queries, about, that are scored in one task at a time
MOST_SEGMENTS = 8  # more are put together
FEW = 100_000  # tokens asked of a scope that go to every task, so that blocks are met where they are read; else blocks may go to the one task that has the queries
POSTINGS_PER_BUCKET = 2_000_000
MANIFEST = "version long, batch long, segments array<string>, buckets int, n long, total long, weights string, card_type string"
TABLES = {  # those that are partitioned, so that an empty one has no file to read a schema from
    "blocks": "token string, scope string, part int, max_f double, min_len long, n long, postings array<struct<card_id:{0},f:double,len:long>>, bucket int",
    "terms": "token string, d long, bucket int",
}
CARD = "card_id {0}, hash string, scope string, len long, tokens array<struct<token:string,f:double,tf:long>>"


def newest(cards: DataFrame) -> DataFrame:
    """One row a card: of several versions the one with the latest updated_at; ties to the larger row hash."""
    rest = [c for c in cards.columns if c != "card_id"]
    order = F.struct(F.col("updated_at"), F.xxhash64(*cards.columns)) if "updated_at" in rest else F.xxhash64(*cards.columns)
    return cards.groupBy("card_id").agg(F.max_by(F.struct(*rest), order).alias("_x")).select("card_id", "_x.*")


def card_tokens(cards: DataFrame, weights: str, also: list[str]) -> DataFrame:
    """(card_id, *also, len, tokens): each card's tokens with weighted and plain counts, counted where the card is, so that no row a token moves."""
    w = WEIGHTS[weights]
    rows = cards.select("card_id", *also, *[field_tokens(f).alias(f"_{f}") for f in FIELDS])
    kept = ["card_id", *also]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = [batch.column(f"_{f}") for f in FIELDS]
                sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy() for x in lists]
                row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
                words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
                many = max(1, len(words.dictionary))
                key, of, tf = np.unique(row * many + words.indices.to_numpy(), return_inverse=True, return_counts=True)
                f = np.bincount(of, np.repeat(w, [n.sum() for n in sizes]), len(key))
                tokens = pa.StructArray.from_arrays([words.dictionary.take(pa.array(key % many)), pa.array(f), pa.array(tf, pa.int64())], ["token", "f", "tf"])
                ends = np.searchsorted(key // many, np.arange(batch.num_rows + 1))
                n = pa.array(np.bincount(row, minlength=batch.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], n, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)], names=[*kept, "len", "tokens"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", len long, tokens array<struct<token:string,f:double,tf:long>>")


def _blocks(cards: pa.Table) -> pa.Table:
    """Cards(card_id, scope, part, len, tokens, f) of one part to blocks: a row a token with its postings."""
    lists = cards.column("tokens").combine_chunks()
    row = np.repeat(np.arange(cards.num_rows), pc.list_value_length(lists).to_numpy())
    words = lists.flatten().dictionary_encode()
    code = words.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    f, n = cards.column("f").combine_chunks().flatten().to_numpy()[order], cards.column("len").to_numpy()[row]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
    each = lambda ufunc, x: pa.array(ufunc.reduceat(x, first) if len(first) else x)
    postings = pa.StructArray.from_arrays([cards.column("card_id").combine_chunks().take(pa.array(row)), pa.array(f), pa.array(n)], ["card_id", "f", "len"])
    ends = np.append(first, len(code))
    same = pa.array(np.zeros(len(first), int))
    return pa.table({
        "token": words.dictionary.take(pa.array(code[first])), "scope": cards.column("scope").combine_chunks().take(same), "part": cards.column("part").combine_chunks().take(same),
        "max_f": each(np.maximum, f), "min_len": each(np.minimum, n), "n": pa.array(np.diff(ends), pa.int64()), "postings": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), postings),
    })


def _best(blocks: pa.Table, asks: pa.Table, k: int, average: float) -> pa.Table:
    """The k best cards of each query among those of blocks(token, part, cards, f, len), in the parts that it needs: asks(query_id, parts, tokens, idf)."""
    rows, found, score = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    names = pa.array([], blocks.column("cards").type.value_type)
    if blocks.num_rows and asks.num_rows:
        lists = blocks.column("cards").combine_chunks()
        n = pc.list_value_length(lists).to_numpy()
        words = blocks.column("token").combine_chunks().dictionary_encode()
        token = np.repeat(words.indices.to_numpy(), n)
        order = np.argsort(token, kind="stable")
        cards = lists.flatten().dictionary_encode()
        by_id = pc.sort_indices(cards.dictionary)
        names, place = cards.dictionary.take(by_id), np.empty(len(by_id), int)
        place[by_id.to_numpy()] = np.arange(len(by_id))
        at = place[cards.indices.to_numpy()]  # cards are numbered by their ids
        part = np.zeros(len(names), int)
        part[at] = np.repeat(blocks.column("part").to_numpy(), n)
        flat = lambda name: blocks.column(name).combine_chunks().flatten().to_numpy()
        f, size = flat("f"), flat("len")
        weight = (f * (K1 + 1) / (f + K1 * (1 - B + B * size / average)))[order]
        at, ends = at[order], np.searchsorted(token[order], np.arange(len(words.dictionary) + 1))
        asked, idf = asks.column("tokens").combine_chunks(), asks.column("idf").combine_chunks().flatten().to_numpy()
        code = pc.fill_null(pc.index_in(asked.flatten(), words.dictionary), -1).to_numpy()
        mine = np.append(0, np.cumsum(pc.list_value_length(asked).to_numpy()))
        for q, parts in enumerate(asks.column("parts").to_pylist()):
            s = np.zeros(len(names))
            for c, x in zip(code[mine[q] : mine[q + 1]].tolist(), idf[mine[q] : mine[q + 1]].tolist(), strict=True):
                if c >= 0:
                    s[at[ends[c] : ends[c + 1]]] += x * weight[ends[c] : ends[c + 1]]
            here = np.flatnonzero((s > 0) & np.isin(part, parts))
            s = np.round(s[here], 6)
            if len(s) > k:
                near = s >= np.partition(s, -k)[-k]
                here, s = here[near], s[near]
            first = np.argsort(-s, kind="stable")[:k]
            rows.append(np.full(len(first), q))
            found.append(here[first])
            score.append(s[first])
    take = lambda x, at: x.take(pa.array(np.concatenate(at)))
    return pa.table({"query_id": take(asks.column("query_id"), rows), "card_id": take(names, found), "bm25": pa.array(np.concatenate(score))})


class CardIndex:
    def __init__(self, spark: SparkSession, root: str, weights: str = "intended", part: int = PART, seeds: int = SEEDS):
        """root: a folder that driver and executors share; weights: a preset of the four fields, fixed by the first batch."""
        self.spark, self.root, self.weights, self.part, self.seeds = spark, root, weights, part, seeds

    def manifest(self) -> dict | None:
        """The newest manifest; None if there is none."""
        try:
            row = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException:
            return None
        return row.asDict() if row else None

    def _read(self, kind: str, m: dict) -> DataFrame:
        read = self.spark.read
        if kind in TABLES:
            read = read.schema(TABLES[kind].format(m["card_type"]))
        parts = [read.parquet(f"{self.root}/{s}/{kind}").withColumn("segment", F.lit(s)) for s in m["segments"]]
        return reduce(DataFrame.unionByName, parts)

    def _live(self, kind: str, m: dict, *columns) -> DataFrame:
        """Rows by card of the segments, without those of replaced and removed versions; of these columns, if any are named."""
        rows = self._read(kind, m)
        rows = rows.select(*columns, "segment") if columns else rows
        return rows if len(m["segments"]) < 2 else rows.join(self._read("dead", m).select("card_id", F.col("of").alias("segment")), ["card_id", "segment"], "left_anti")

    def cards(self) -> DataFrame:
        """The state: (card_id, hash, scope, len, tokens, segment) of each card in the index."""
        return self._live("cards", self._must())

    def postings(self) -> DataFrame:
        """(card_id, token, f, tf, len): weighted and plain counts of each card's tokens, and the card's length."""
        return self.cards().select("card_id", F.explode("tokens").alias("x"), "len").select("card_id", "x.token", "x.f", "x.tf", "len")

    def vectors(self) -> DataFrame:
        """(card_id, embedding, scope) of the cards whose vector is known."""
        return self._live("vectors", self._must()).select("card_id", "embedding", "scope")

    def _must(self) -> dict:
        m = self.manifest()
        if not m:
            raise ValueError(f"no index in {self.root}")
        return m

    def commit(self, batch: int, cards: DataFrame, snapshot: bool = False, embed: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Takes a batch of cards(card_id, title, summary, details, tags, scope[, updated_at][, removed]) into the index; False if it is in already.

        Of several versions of a card the newest counts. Cards whose content or scope is new get new postings; those marked
        `removed` go, and in a snapshot all that are not in it. embed(changed cards) -> (card_id, embedding): a changed card
        without vector keeps its old vector out and no hash, so that it is tried again when it comes next. Batches are
        numbered upwards; rerunning one changes nothing.
        """
        m = self.manifest()
        if m and batch <= m["batch"]:
            return False
        name = f"segment-{batch}"
        at = f"{self.root}/{name}"
        kind = dict(cards.dtypes)["card_id"]
        old = self.cards().drop("tokens") if m else self.spark.createDataFrame([], CARD.format(kind) + ", segment string").drop("tokens")
        weights = m["weights"] if m else self.weights
        rows = newest(cards)
        removed = F.coalesce(F.col("removed"), F.lit(False)) if "removed" in cards.columns else F.lit(False)
        rows = rows.withColumns({"_hash": content_hash(F.col("title"), F.col("summary"), F.col("details"), F.col("tags")), "_gone": removed})
        known = old.select("card_id", F.col("hash").alias("_old"), F.col("scope").alias("_scope"), F.col("segment").alias("_of"))
        met = rows.join(known, "card_id", "full" if snapshot else "left")
        stays = F.col("_hash").eqNullSafe(F.col("_old")) & F.col("scope").eqNullSafe(F.col("_scope"))
        gone = F.col("_gone").isNull() | F.col("_gone")
        met = met.where(F.when(gone, F.col("_of").isNotNull()).otherwise(~stays))
        met.withColumn("_gone", gone).write.mode("overwrite").parquet(f"{at}/batch")
        met = self.spark.read.parquet(f"{at}/batch")
        changed = met.where("not _gone")
        met.where("_of is not null").select("card_id", F.col("_of").alias("of")).write.mode("overwrite").parquet(f"{at}/dead")
        hash_ = F.col("_hash")
        if embed:
            embed(changed).select("card_id", "embedding").join(changed.select("card_id", "scope"), "card_id").where("embedding is not null").write.mode("overwrite").parquet(f"{at}/vectors")
            landed = self.spark.read.parquet(f"{at}/vectors").select("card_id", F.lit(True).alias("_landed"))
            changed = changed.join(landed, "card_id", "left")
            hash_ = F.when(F.col("_landed"), hash_)
        else:
            self.spark.createDataFrame([], f"card_id {kind}, embedding array<double>, scope string").write.mode("overwrite").parquet(f"{at}/vectors")
        card_tokens(changed.withColumn("hash", hash_), weights, ["hash", "scope"]).write.mode("overwrite").parquet(f"{at}/cards")
        new = self.spark.read.parquet(f"{at}/cards")
        dead = self.spark.read.parquet(f"{at}/dead").withColumnRenamed("of", "segment")
        lost = lambda *columns: self._live("cards", m, "card_id", *columns).join(dead, ["card_id", "segment"], "left_semi")
        count = lambda df, *more: df.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)), *more).first()
        more = count(new, F.coalesce(F.sum(F.size("tokens")), F.lit(0)))
        less = count(lost("len")) if m else (0, 0)
        buckets = m["buckets"] if m else max(8, min(4096, -(-more[2] // POSTINGS_PER_BUCKET)))
        self._write_postings(at, new, lost(F.col("tokens.token").alias("token")) if m else None, buckets)
        self._sign({"batch": batch, "segments": [*(m["segments"] if m else []), name], "buckets": buckets, "n": (m["n"] if m else 0) + more[0] - less[0], "total": (m["total"] if m else 0) + more[1] - less[1], "weights": weights, "card_type": kind})
        if len(self._must()["segments"]) > MOST_SEGMENTS:
            self.compact()
        return True

    def _sign(self, m: dict) -> None:
        """Writes a manifest of the next version: one file, which is there or not; two writers of one version cannot both succeed."""
        last = self.manifest()
        version = last["version"] + 1 if last else 1
        row = self.spark.createDataFrame([(version, m["batch"], m["segments"], m["buckets"], m["n"], m["total"], m["weights"], m["card_type"])], MANIFEST)
        row.coalesce(1).write.mode("error").json(f"{self.root}/manifest/version={version}")

    def _write_postings(self, at: str, new: DataFrame, lost: DataFrame | None, buckets: int) -> None:
        """Blocks and document frequencies of the new cards, less those of the lost ones' tokens(token: array). Whole cards meet by part, and then blocks by bucket."""
        bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
        kind = TABLES["blocks"].format(dict(new.dtypes)["card_id"])
        sizes = new.groupBy("scope").agg(F.ceil(F.count("*") / self.part).cast("int").alias("_parts")).withColumnRenamed("scope", "_s")
        rows = new.join(sizes, F.col("scope").eqNullSafe(F.col("_s"))).withColumn("part", F.pmod(F.xxhash64("card_id"), F.col("_parts")).cast("int"))
        rows = rows.select("card_id", "scope", "part", "len", F.col("tokens.token").alias("tokens"), F.col("tokens.f").alias("f"))
        blocks = rows.groupBy("scope", "part").applyInArrow(_blocks, kind.removesuffix(", bucket int"))
        blocks.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/blocks")
        terms = self.spark.read.schema(kind).parquet(f"{at}/blocks").select("token", F.col("n").alias("d"))
        terms = terms if lost is None else terms.unionByName(lost.select(F.explode("token").alias("token"), F.lit(-1).alias("d")))
        terms = terms.groupBy("token").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("bucket", bucket)
        terms.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/terms")

    def compact(self) -> None:
        """Puts all segments together into one; searches see the same cards before and after."""
        m = self._must()
        name = f"segment-{m['batch']}-{len(m['segments'])}"
        at = f"{self.root}/{name}"
        self.cards().drop("segment").write.mode("overwrite").parquet(f"{at}/cards")
        self.vectors().write.mode("overwrite").parquet(f"{at}/vectors")
        self._read("dead", m).drop("segment").where("false").write.mode("overwrite").parquet(f"{at}/dead")
        new = self.spark.read.parquet(f"{at}/cards")
        size = new.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
        buckets = max(8, min(4096, -(-size // POSTINGS_PER_BUCKET)))
        self._write_postings(at, new, None, buckets)
        self._sign(m | {"segments": [name], "buckets": buckets})

    def search(self, queries: DataFrame, k: int = 64, scoped: bool = True) -> DataFrame:
        """R2: (query_id, card_id, bm25) of the k best cards of each query(query_id, tokens, scopes), best first, ties to the smaller card_id.

        Only the buckets of the asked tokens are read, of most blocks only the heads, and nothing is written. scoped: a
        query meets only cards of the scopes that it lists; frequencies and lengths are those of all cards either way.
        """
        m = self._must()
        asked = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("token"), *(["scopes"] if scoped else []))
        asked = asked.select("query_id", "token", F.explode(F.array_distinct("scopes")).alias("scope")) if scoped else asked
        on = ["token", "scope"] if scoped else ["token"]
        hashed = F.pmod(F.xxhash64("token"), F.lit(m["buckets"])).cast("int")
        needed = [r[0] for r in queries.select(F.explode("tokens").alias("token")).select(hashed.alias("b")).distinct().collect()]  # as many as there are buckets, at most
        among = F.col("bucket").isin(needed) if needed else F.lit(False)
        terms = self._read("terms", m).where(among)
        df = terms.select("token", F.col("d").alias("df")) if len(m["segments"]) == 1 else terms.groupBy("token").agg(F.sum("d").alias("df"))
        idf = F.log((m["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = asked.join(df, "token").withColumn("idf", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf))
        average = m["total"] / m["n"] if m["n"] else 1.0
        score = lambda f, n: F.col("idf") * (f * (K1 + 1)) / (f + K1 * (1 - B + B * n / average))
        n = asked.agg(F.count("*"), F.count_distinct("query_id")).first()
        few = F.broadcast if n[0] <= FEW else lambda df: df
        blocks = self._read("blocks", m).where(among)
        where = ["query_id", "segment", "scope", "part"]
        heads = blocks.select("token", "scope", "part", "segment", "max_f", "min_len", "n").join(few(asked), on)
        bounds = heads.groupBy(*where).agg(F.sum(score(F.col("max_f"), F.col("min_len"))).alias("bound"))
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "scope", "part")
        seeds = bounds.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= self.seeds)
        how = few, max(1, -(-n[1] // QUERIES)), k, average, m
        kth = top_cards(self._scored(blocks, asked, on, seeds, *how), k).where(F.col("_rank") == k - 1)
        rest = bounds.join(kth.select("query_id", F.col("bm25").alias("floor")), "query_id", "left").where(F.coalesce(F.col("bound") + 1e-5 >= F.col("floor"), F.lit(True)))
        return top_cards(self._scored(blocks, asked, on, rest, *how), k).drop("_rank")

    def _scored(self, blocks: DataFrame, asked: DataFrame, on: list[str], parts: DataFrame, few: Callable, deals: int, k: int, average: float, m: dict) -> DataFrame:
        """(query_id, card_id, bm25) of living cards of the parts (query_id, segment, scope, part): of some PARTS parts that meet in a task the k best a query.

        Blocks of the asked tokens move once to where their parts meet the queries, dealt into `deals`; no row a query and card is shuffled.
        """
        group = F.floor(F.col("part") / PARTS).cast("int").alias("g")
        needed = parts.select(*[F.col(c).alias(f"_{c}") for c in ("segment", "scope", "part")]).distinct()
        needed = F.broadcast(needed) if m["n"] / self.part <= FEW else needed
        same = (F.col("segment") == F.col("_segment")) & (F.col("part") == F.col("_part")) & F.col("scope").eqNullSafe(F.col("_scope"))
        rows = blocks.join(few(asked.select(*on).distinct()), on).join(needed, same, "left_semi").select("token", "segment", "scope", "part", "postings")
        if len(m["segments"]) > 1:
            dead = self._read("dead", m).select("card_id", F.col("of").alias("segment"))
            rows = rows.select("token", "segment", "scope", "part", F.explode("postings").alias("x")).withColumn("card_id", F.col("x.card_id")).join(dead, ["card_id", "segment"], "left_anti")
            rows = rows.groupBy("token", "segment", "scope", "part").agg(F.collect_list("x").alias("postings"))
        lists = [F.col(f"postings.{c}").alias(name) for c, name in (("card_id", "cards"), ("f", "f"), ("len", "len"))]
        left = rows.select("segment", "scope", group, F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), "token", "part", *lists)
        asks = asked.groupBy("query_id", *on[1:]).agg(F.collect_list("token").alias("tokens"), F.collect_list("idf").alias("idf"))
        deal = F.pmod(F.xxhash64("query_id"), F.lit(deals)).cast("int").alias("deal")
        right = parts.groupBy("query_id", "segment", "scope", group).agg(F.collect_list("part").alias("parts")).join(asks, ["query_id", *on[1:]])
        right = right.select(*[F.col(c).alias(c) for c in ("segment", "scope", "g", "query_id", "parts", "tokens", "idf")], deal)
        keys = ["segment", "scope", "g", "deal"]
        kinds = dict(asked.dtypes)["query_id"], m["card_type"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _best(a, b, k, average), f"query_id {kinds[0]}, card_id {kinds[1]}, bm25 double")


def top_cards(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "card_id")
    return scored.withColumn("_rank", F.row_number().over(w) - 1).where(F.col("_rank") < k)
