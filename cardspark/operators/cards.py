"""Cards and materials: replies to cards, de-duplication, aggregation, selection, updates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import regexes as R
from ..functions.folds import fold_sorted
from ..functions.ordered import numbered
from ..sources.shared import written
from .text import _bigrams, escape_attribute, escape_envelope, js_trim, truncate_head_tail

#: In the order in which study sheets list them.
TYPE_ORDER = ("result_impact", "data_metric", "difficulty_solution", "decision_tradeoff", "tech_principle", "process_method", "domain_fact")
LANGUAGES = ("zh", "en", "bilingual")
REPLIES = 256  # that are parsed at a time
CARD = "struct<type:string,title:string,summary:string,details:string,tags:array<string>,language:string,confidence:double>"


def type_priority(c: Column) -> Column:
    out = F.when(c == TYPE_ORDER[0], 0)
    for i, t in enumerate(TYPE_ORDER[1:], 1):
        out = out.when(c == t, i)
    return out.otherwise(9)


# Replies to cards.


def scan_objects(text: str) -> tuple[list[dict], str]:
    """The complete outermost {..} objects of a growing text, and the unfinished rest; what does not parse is skipped."""
    out, depth, start, quoted, escaped, end = [], 0, 0, False, False, 0
    for i, c in enumerate(text):
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                end = i + 1
                try:
                    out.append(json.loads(text[start:end]))
                except ValueError:
                    pass
    return out, text[start:] if depth else text[end:]


def check_card(o) -> tuple[dict | None, list[str]]:
    """A card with what is mended silently, or the issues that reject it."""
    issues = []
    if not isinstance(o, dict):
        return None, ["not an object"]
    text = {k: o.get(k, "" if k == "summary" else None) for k in ("title", "summary", "details")}
    for k, (lo, hi) in {"title": (2, 100), "summary": (0, 300), "details": (10, 2000)}.items():
        if not isinstance(text[k], str) or not lo <= len(text[k]) <= hi:
            issues.append(f"{k}: {lo} to {hi} characters")
    raw = o.get("confidence")
    try:
        confidence = float(0.5 if raw is None else raw)
    except (TypeError, ValueError):
        confidence = float("nan")
    if confidence != confidence:
        issues.append("confidence: a number")
    if issues:
        return None, issues
    tags = o.get("tags")
    return {
        "type": o.get("type") if o.get("type") in TYPE_ORDER else "domain_fact", **text, "tags": [str(t) for t in tags] if isinstance(tags, list) else [],
        "language": o.get("language") if o.get("language") in LANGUAGES else "zh", "confidence": min(1.0, max(0.0, confidence)),
    }, []


def parse_reply(raw: str) -> list | None:
    """The reply's array; one that breaks off is cut after its last whole object; null if there is none."""
    import re

    s = re.sub(r"(?is)<think[^>]*>.*?</think>", "", raw or "")
    s = re.sub(r"```(?:json)?", "", s).strip()
    at = s.find("[")
    s = s[at:] if at >= 0 else s
    for cut in (s, s[: s.rfind("]") + 1], s[: s.rfind("}") + 1] + "]"):
        try:
            value = json.loads(cut)
        except ValueError:
            continue
        return value if isinstance(value, list) else None
    return None


def parse_cards(replies: DataFrame) -> DataFrame:
    """replies(request_id, project_id, raw) -> request_id, project_id, seq, card, issues. A reply without array has one row of issues.

    A task takes REPLIES of a batch at a time, so that it holds no more cards than theirs.
    """

    kinds = dict(replies.dtypes)
    schema = f"request_id {kinds['request_id']}, project_id {kinds['project_id']}, seq long, card {CARD}, issues array<string>"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, REPLIES):
                rows = []
                for request, project, raw in zip(*(c.to_pylist() for c in whole.slice(at, REPLIES).columns), strict=True):
                    found = parse_reply(raw)
                    if found is None:
                        rows.append((request, project, -1, None, ["not an array"]))
                    else:
                        rows += [(request, project, i, *check_card(o)) for i, o in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

    return replies.select("request_id", "project_id", "raw").mapInArrow(run, schema)


# De-duplication.


def dedup_titles(cards: DataFrame, order: str = "card_id") -> DataFrame:
    """The first card of each title within a project."""
    w = Window.partitionBy("project_id", "title").orderBy(order)
    return cards.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def card_keywords(text: Column) -> Column:
    """Latin words of two letters or more, CJK characters but for stop words, and CJK bigrams."""
    han = F.filter(F.regexp_extract_all(text, F.lit(f"({R.HAN})"), 1), lambda x: ~x.isin(*R.DEDUP_STOP))
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), 1), han, _bigrams(text)))


def overlapping_pairs(rows: DataFrame, limit: float = 0.65, block: int = 8192) -> DataFrame:
    """(project_id, early, late) of rows(project_id, o, k) whose keyword overlap |A and B| / min(|A|, |B|) exceeds the limit.

    A project's rows are dealt into blocks of some `block` rows, and each two blocks meet in one task, which gives out only
    pairs that may pass; so what moves is each row's hashed words once a block of its project, never a row a pair that shares
    a word. A word's hash may be another's too, which only adds to an overlap; the pairs given out are then compared by words.
    """
    n = rows.groupBy("project_id").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    deal = F.pmod(F.xxhash64("o"), F.col("_n")).cast("int")
    dealt = rows.join(n, "project_id").select("project_id", "o", F.transform("k", lambda w: F.hash(w)).alias("h"), deal.alias("_d"), "_n")
    left = dealt.select("project_id", "o", "h", F.col("_d").alias("i"), F.explode(F.sequence(F.col("_d"), F.col("_n") - 1)).alias("j"))
    right = dealt.select(*[F.col(c).alias(c) for c in ("project_id", "o", "h")], F.explode(F.sequence(F.lit(0), F.col("_d"))).alias("i"), F.col("_d").alias("j"))
    kinds = dict(rows.dtypes)
    meet = lambda a, b: _may_overlap(a, b, limit)
    by = ["project_id", "i", "j"]
    pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, f"project_id {kinds['project_id']}, a {kinds['o']}, b {kinds['o']}")
    pairs = written(pairs)
    full = pairs.join(rows.withColumnsRenamed({"o": "a", "k": "ka"}), ["project_id", "a"]).join(rows.withColumnsRenamed({"o": "b", "k": "kb"}), ["project_id", "b"])
    near = full.where(F.size(F.array_intersect("ka", "kb")) / F.least(F.size("ka"), F.size("kb")) > limit)
    return near.select("project_id", F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late"))


def _may_overlap(a: pa.Table, b: pa.Table, limit: float, wide: int = 1024, slab: int = 1024) -> pa.Table:
    """Pairs of two blocks (project_id, o, h: hashed words) whose hashes overlap by more than the limit; of one block with itself, each once.

    Hashes counted in `wide` columns multiply to an overlap or more; where that passes, the hashes themselves are compared."""
    found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if a.num_rows and b.num_rows:
        (na, ha), (nb, hb) = _flat(a), _flat(b)
        rb = np.repeat(np.arange(len(nb)), nb)
        keys = np.unique((rb << 32) | hb)
        counts = _counted(nb, hb, wide)
        same = a.column("i")[0] == b.column("j")[0]
        at = np.concatenate(([0], np.cumsum(na)))
        oa, ob = (t.column("o").to_numpy() for t in (a, b)) if same else (None, None)
        for start in range(0, len(na), slab):
            stop = min(start + slab, len(na))
            least = limit * np.minimum(na[start:stop, None], nb[None, :]).astype(np.float32) - 1e-3
            p, q = np.nonzero(_counted(na[start:stop], ha[at[start] : at[stop]], wide) @ counts.T >= least)
            p += start
            if same:
                once = oa[p] < ob[q]
                p, q = p[once], q[once]
            for cut in range(0, len(p), 200_000):
                i, j = p[cut : cut + 200_000], q[cut : cut + 200_000]
                size = na[i]
                first = np.cumsum(size) - size
                word = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(at[i], size)
                key = (np.repeat(j, size) << 32) | ha[word]
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                near = np.add.reduceat((keys[place] == key).astype(np.int64), first) >= limit * np.minimum(size, nb[j]) - 1e-3
                found[0].append(i[near])
                found[1].append(j[near])
    i, j = (pa.array(np.concatenate(f)) for f in found)
    return pa.table({"project_id": a.column("project_id").take(i), "a": a.column("o").take(i), "b": b.column("o").take(j)})


def _flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes each row has, and all of them, as numbers from 0 to 2^32."""
    h = t.column("h").combine_chunks()
    return h.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), h.flatten().to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF


def _counted(n: np.ndarray, h: np.ndarray, wide: int) -> np.ndarray:
    out = np.bincount(np.repeat(np.arange(len(n)), n) * wide + h % wide, minlength=len(n) * wide)
    return out.astype(np.float32).reshape(len(n), wide)


class _Sets:
    """Sets of words as numbers: how many each has, and all of them, one set after the other, each in order."""

    def __init__(self, size: np.ndarray, words: np.ndarray):
        self.size, self.words, self.start = size, words, np.cumsum(size) - size

    def __len__(self) -> int:
        return len(self.size)

    def where(self, keep: np.ndarray) -> _Sets:
        return _Sets(self.size[keep], self.words[np.repeat(keep, self.size)])

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.size)

    def signatures(self) -> list[np.ndarray]:
        """512 bits a set, in eight numbers."""
        bits = np.zeros((len(self), 512), np.uint8)
        bits[self.rows(), self.words % 512] = 1
        return list(np.packbits(bits, axis=1).view(np.uint64).T.copy())


def _sets(*tables: pa.Table) -> list[_Sets]:
    """Each table's column t, words between spaces; a word has one number in all tables, the rarer the smaller."""
    lists = [pc.split_pattern(t.column("t").combine_chunks(), " ") for t in tables]
    codes = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode().indices.to_numpy()
    count = np.bincount(codes)
    rank = np.zeros(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    sizes = [x.value_lengths().to_numpy().astype(np.int64) for x in lists]
    size = np.concatenate(sizes)
    words = np.sort((np.repeat(np.arange(len(size)), size) << 32) | rank[codes]) & 0xFFFFFFFF
    return [_Sets(n, w) for n, w in zip(sizes, np.split(words, np.cumsum([n.sum() for n in sizes])[:-1]), strict=True)]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. size[0] numbers, then start[1], .."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _covered(early: _Sets, late: _Sets, limit: float, most: int = 1 << 19) -> np.ndarray:
    """Which late sets overlap an early one by more than the limit.

    Of an overlap of at least m of a smaller set's n words, one is among any n - m + 1 of them: the rarest find candidates, `most`
    or so at a time; signatures bound their overlap, and the words decide. A late set that is known
    to be covered is not compared again.
    """
    gone = np.zeros(len(late), bool)
    if not len(early) or not len(late):
        return gone
    n_words, marks = int(max(early.words.max(), late.words.max())) + 1, {id(x): x.signatures() for x in (early, late)}
    for small, large, late_is_small in ((early, late, False), (late, early, True)):
        rows, held = small.rows(), large.rows()
        keys = (held << 32) | large.words
        need = np.ceil(limit * small.size - 1e-6).astype(np.int64)
        chosen = np.arange(len(rows)) - small.start[rows] < (small.size - need + 1)[rows]
        owner, word = rows[chosen], small.words[chosen]
        asked = np.bincount(word, minlength=n_words) > 0
        held = held[asked[large.words]]
        posts = ((keys & 0xFFFFFFFF)[asked[large.words]] << 32) | large.size[held]
        order = np.argsort(posts)
        posts, holders = posts[order], held[order]  # by word, then size
        end = np.cumsum(np.bincount(posts >> 32, minlength=n_words))
        order = np.argsort((word << 32) | small.size[owner])
        owner, word = owner[order], word[order]
        start = np.searchsorted(posts, (word << 32) | small.size[owner])
        n = end[word] - start
        owner, start, n = (x[n > 0] for x in (owner, start, n))
        order = np.argsort(small.size[owner], kind="stable")  # small sets cover most
        owner, start, n = owner[order], start[order], n[order]
        mine, theirs = marks[id(small)], marks[id(large)]
        least = (need - small.size + sum(np.bitwise_count(x).astype(np.int64) for x in mine)).astype(np.int16)  # at least so many bits are in both
        total = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            a, begin, size = owner[at:to], start[at:to], n[at:to]
            at = to
            if late_is_small:
                a, begin, size = (x[~gone[a]] for x in (a, begin, size))
            b = holders[_ranges(begin, size)]
            both = np.zeros(len(b), np.int16)
            for x, y in zip(mine, theirs, strict=True):
                both += np.bitwise_count(np.repeat(x[a], size) & y[b])
            near = both >= np.repeat(least[a], size)
            a, b = np.repeat(a, size)[near], b[near]
            if not late_is_small:
                a, b = a[~gone[b]], b[~gone[b]]
            a, b = np.divmod(np.unique(a * len(large) + b), len(large))
            of = a if late_is_small else b
            once = np.unique(of, return_index=True)[1]  # the first candidate of each late set, then those of sets that it does not cover
            rest = np.setdiff1d(np.arange(len(of)), once, assume_unique=True)
            for pick in (once, *np.split(rest, np.arange(1 << 16, len(rest), 1 << 16))):
                pick = pick[~gone[of[pick]]]
                pick = pick[np.argsort(b[pick])]  # near each other in keys
                if len(pick):
                    i, j = a[pick], b[pick]
                    key = (np.repeat(j, small.size[i]) << 32) | small.words[_ranges(small.start[i], small.size[i])]
                    same = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                    overlap = np.add.reduceat(same.astype(np.int64), np.cumsum(small.size[i]) - small.size[i])
                    gone[of[pick[overlap / small.size[i] > limit]]] = True
    return gone


def _stays(sets: _Sets, limit: float, few: int = 128) -> np.ndarray:
    """Which of the sets, in order, overlap none before them that stays: of a few by all pairs, of more by halves."""
    if len(sets) <= few:
        words, code = np.unique(sets.words, return_inverse=True)
        has = np.zeros((len(sets), len(words)), np.float32)
        has[sets.rows(), code] = 1
        near = has @ has.T / np.minimum(sets.size[:, None], sets.size[None, :]).astype(np.float64) > limit
        out = np.zeros(len(sets), bool)
        for i in range(len(sets)):
            out[i] = not (near[i, :i] & out[:i]).any()
        return out
    early = np.arange(len(sets)) < len(sets) // 2
    first = sets.where(early)
    out = np.zeros(len(sets), bool)
    out[early] = _stays(first, limit, few)
    open_ = np.flatnonzero(~early)
    second = sets.where(~early)
    free = ~_covered(first.where(out[early]), second, limit)
    if free.any():
        out[open_[free]] = _stays(second.where(free), limit, few)
    return out


def dedup_cards(cards: DataFrame, order: str = "card_id", limit: float = 0.65, block: int = 1 << 16) -> DataFrame:
    """In order, a card goes if it overlaps a card that stays.

    Of a project's cards with the same keywords only the first can stay: the later ones overlap all that it overlaps, and it.
    A project's cards are dealt, in order, into blocks of `block`, which settle one after the other in all projects at once:
    each earlier block's cards that stay meet the block in a task of their own, which gives out what they cover, and one task
    settles the rest. So what moves is each card once a block of its project, never a pair of cards, however many overlap.
    What stays is written to the shared folder.
    """
    keys = F.array_join(card_keywords(F.concat("title", "summary")), " ")
    rows = written(cards.select("project_id", F.col(order).alias("o"), keys.alias("t")).where((F.col("t") != "") & F.col("project_id").isNotNull() & F.col("o").isNotNull()))
    first = written(rows.groupBy("project_id", F.array_join(F.array_sort(F.split("t", " ")), " ").alias("t")).agg(F.min("o").alias("o")))
    places = numbered(first.select("project_id", "o"), ["project_id", "o"])
    places = places.join(F.broadcast(places.groupBy("project_id").agg(F.min("pos").alias("_first"))), "project_id")  # as many rows as projects
    starts = written(places.where((F.col("pos") - F.col("_first")) % block == 0).groupBy("project_id").agg(F.array_sort(F.collect_list("o")).alias("starts")))
    dealt = first.join(F.broadcast(starts), "project_id").withColumn("b", F.size(F.filter("starts", lambda s: s <= F.col("o"))) - 1)
    kinds = dict(first.dtypes)
    cover, settle = lambda early, late: _gone(early, late, limit), lambda t: _kept(t, limit)
    kept = None
    for b in range(starts.agg(F.max(F.size("starts"))).first()[0] or 0):
        now = dealt.where(F.col("b") == b).select("project_id", "o", "t")
        if b:
            later = F.broadcast(starts.where(F.size("starts") > b).select("project_id"))
            late = now.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
            by = ["project_id", "b"]
            gone = kept.join(later, "project_id", "left_semi").groupBy(*by).cogroup(late.groupBy(*by)).applyInArrow(cover, f"project_id {kinds['project_id']}, o {kinds['o']}")
            # not an anti join, which Spark would push below the choice of a block, so that all blocks are shuffled
            now = now.join(gone.withColumn("_gone", F.lit(True)), ["project_id", "o"], "left").where("_gone is null").drop("_gone")
        new = written(now.groupBy("project_id").applyInArrow(settle, now.schema)).withColumn("b", F.lit(b))
        kept = kept.unionByName(new) if kept else new
    if kept is None:
        return cards
    gone = rows.select("project_id", "o").join(kept.select("project_id", "o"), ["project_id", "o"], "left_anti").withColumnRenamed("o", order)
    return cards.join(gone, ["project_id", order], "left_anti")


def _gone(early: pa.Table, late: pa.Table, limit: float) -> pa.Table:
    """The late cards that early ones overlap, of tables with t, words between spaces."""
    found = _covered(*_sets(early, late), limit) if early.num_rows and late.num_rows else np.zeros(late.num_rows, bool)
    return late.select(["project_id", "o"]).filter(pa.array(found))


def _kept(cards: pa.Table, limit: float) -> pa.Table:
    """The cards that stay of those that no earlier block covers."""
    cards = cards.sort_by("o")
    return cards.filter(pa.array(_stays(*_sets(cards), limit)))


# Aggregations.


def type_counts(cards: DataFrame) -> DataFrame:
    """A3"""
    return cards.groupBy("project_id", "type").agg(F.count("*").alias("n"))


def export_counts(cards: DataFrame) -> DataFrame:
    """A4: sizes of the three export ranges."""
    imp = F.count_if("is_important")
    return cards.groupBy("project_id").agg(F.least(F.lit(25), F.when(imp >= 3, imp).otherwise(F.count("*"))).alias("auto"), F.count("*").alias("all"), imp.alias("important"))


def material_coverage(materials: DataFrame, projects: DataFrame, profile: dict, application: dict) -> DataFrame:
    """A5: how many of the suggested kinds a project has; a kind is a list of types or categories."""
    have = materials.groupBy(F.col("project_id").alias("id")).agg(F.array_union(F.collect_set("type"), F.collect_set("category")).alias("have"))
    hits = lambda kinds: sum((F.arrays_overlap("have", F.array(*map(F.lit, k))).cast("int") for k in kinds.values()), F.lit(0))
    rows = projects.select("id", "is_profile").join(have, "id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    return rows.select("id", F.when(F.col("is_profile"), hits(profile)).otherwise(hits(application)).alias("covered"), F.when(F.col("is_profile"), len(profile)).otherwise(len(application)).alias("total"))


def prompt_assembly(materials: DataFrame, projects: DataFrame, category: str = "project", limit: int = 12_000) -> DataFrame:
    """Per project a header and its materials in escaped envelopes, oldest first; texts are cut before they move."""
    envelope = F.concat(F.lit('<material type="'), escape_attribute(F.col("type")), F.lit('" ref="'), escape_attribute(F.col("source_ref")), F.lit('">\n'), escape_envelope(truncate_head_tail(F.col("raw_content"), limit)), F.lit("\n</material>"))
    parts = materials.where(F.col("category") == category).select("project_id", F.struct("uploaded_at", "id", envelope.alias("t")).alias("x")).groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias("parts"))
    role = F.substring(js_trim(F.split("target_role", "\n")[0]), 1, 80)
    head = F.concat_ws("\n", F.concat(F.lit("role: "), role), F.concat(F.lit("jd: "), F.substring("jd_text", 1, 3000)))
    return projects.join(parts, projects["id"] == parts["project_id"]).select("project_id", F.concat(head, F.lit("\n\n"), F.array_join("parts", "\n\n")).alias("prompt"))


# Selection and order.


def sort_cards(cards: DataFrame, by: str) -> DataFrame:
    """K1: adds `place`, each card's place in its project under an order; newest first among equals."""
    key = {"newest": [], "oldest": [F.asc("created_at")], "confidence_desc": [F.desc("confidence")], "confidence_asc": [F.asc("confidence")], "important": [F.desc("is_important")], "review": [F.coalesce("due_at", F.lit(0)).asc()]}[by]
    return cards.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(*key, F.desc("created_at"), F.asc("card_id"))))


def select_export(cards: DataFrame, mode: str = "auto", limit: int = 25) -> DataFrame:
    """K2: the cards of an export with `place`: by type, in order of card_id within a type. auto takes important ones only where there are three."""
    project = Window.partitionBy("project_id")
    if mode == "important":
        cards = cards.where("is_important")
    elif mode == "auto":
        cards = cards.withColumn("_imp", F.count_if("is_important").over(project)).where("_imp < 3 or is_important").drop("_imp")
    rows = cards.withColumn("place", F.row_number().over(project.orderBy(type_priority(F.col("type")), "card_id")))
    return rows.where(F.col("place") <= limit) if mode == "auto" else rows


def project_list(projects: DataFrame) -> DataFrame:
    """K4: projects that are no profiles, the newest update first."""
    rows = numbered(projects.where(~F.coalesce("is_profile", F.lit(False))), [F.desc("updated_at"), F.col("id")])
    return rows.withColumn("place", F.col("pos") + 1).drop("pos", "part")


def material_list(materials: DataFrame) -> DataFrame:
    """K4: the materials of each project, the newest upload first."""
    return materials.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("uploaded_at"), "id")))


def due_cards(cards: DataFrame, now: int) -> DataFrame:
    """K3: cards never reviewed or due, with their place, never reviewed first."""
    return cards.where(F.col("due_at").isNull() | (F.col("due_at") <= now)).withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("due_at").asc_nulls_first(), "card_id")))


def cheat_sheet(cards: DataFrame, projects: DataFrame, date: str, made_by: str) -> DataFrame:
    """K7: one markdown sheet per project of its auto export."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("\n*关键词："), F.array_join("tags", " · "), F.lit("*\n"))).otherwise(F.lit(""))
    card = F.concat(F.lit("### "), F.when(F.col("is_important"), "★ ").otherwise(""), F.col("title"), F.lit("\n> "), F.col("summary"), F.lit("\n\n"), F.col("details"), F.lit("\n"), tags)
    first = F.row_number().over(Window.partitionBy("project_id", "type").orderBy("place")) == 1
    rows = select_export(cards).withColumn("_c", F.concat(F.when(first, F.concat(F.lit("## "), F.col("type"), F.lit("\n\n"))).otherwise(""), card))
    sheets = rows.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("place", "_c"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["_c"]), "\n")
    head = F.concat(F.lit("# "), F.col("name"), F.lit(" · 会议备忘录\n**会议主题：** "), F.substring(js_trim(F.split("target_role", "\n")[0]), 1, 80), F.lit(f"    **生成日期：** {date}\n\n---\n\n"))
    foot = F.concat(F.lit("\n---\n*共 "), F.size("x"), F.lit(f" 张卡片 · {made_by}*"))
    return sheets.join(projects, sheets["project_id"] == projects["id"]).select("project_id", F.concat(head, body, foot).alias("sheet"))


def index_note(cards: DataFrame, projects: DataFrame) -> DataFrame:
    """K8: a note that links every exported card (project_id, type, filename, is_important, place), by type, unknown types last."""
    link = F.concat(F.lit("- "), F.when(F.col("is_important"), "★ ").otherwise(""), F.lit("[["), F.col("filename"), F.lit("]]"))
    types = cards.groupBy("project_id", "type").agg(F.min("place").alias("p"), F.array_sort(F.collect_list(F.struct("place", link.alias("l")))).alias("x"), F.count("*").alias("n"))
    block = F.concat(F.lit("## "), F.col("type"), F.lit("\n"), F.array_join(F.transform("x", lambda x: x["l"]), "\n"), F.lit("\n"))
    notes = types.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(type_priority(F.col("type")).alias("t"), "p", block.alias("b")))).alias("y"), F.sum("n").alias("n"))
    role = js_trim(F.substring(js_trim(F.split("target_role", "\n")[0]), 1, 80))
    head = F.concat(F.lit("# "), F.col("name"), F.lit(" · 会议卡片索引\n"), F.when(role != "", F.concat(F.lit("**会议主题：** "), role, F.lit("\n"))).otherwise(""), F.lit("\n共 "), F.col("n"), F.lit(" 张卡片。\n\n"))
    return notes.join(projects, notes["project_id"] == projects["id"]).select("project_id", F.concat(head, F.array_join(F.transform("y", lambda y: y["b"]), "\n")).alias("note"))


def filter_notes(notes: DataFrame, folders: list[str], tags: list[str], only_changed: bool) -> DataFrame:
    """K6: notes(folder, tags, status)"""
    out = notes.where(F.col("folder").isin(*folders))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return out.where("status <> 'unchanged'") if only_changed else out


# Joins and updates.


def note_status(notes: DataFrame, prior: DataFrame) -> DataFrame:
    """notes(project_id, source_ref, mtime_ms) against prior(project_id, source_ref, source_mtime in seconds)."""
    p = prior.select("project_id", "source_ref", "source_mtime", F.lit(1).alias("_known"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col("source_mtime").isNull() | (F.floor(F.col("mtime_ms") / 1000) > F.col("source_mtime")), "changed").otherwise("unchanged")
    return notes.join(p, ["project_id", "source_ref"], "left").withColumn("status", status).drop("source_mtime", "_known")


def changed_cards(cards: DataFrame, state: DataFrame) -> DataFrame:
    """cards(card_id, hash) whose hash differs from state(card_id, content_hash), or is not there."""
    return cards.join(state, "card_id", "left").where(~F.col("hash").eqNullSafe(F.col("content_hash"))).select(cards.columns)


def unindexed_cards(cards: DataFrame, state: DataFrame) -> DataFrame:
    """J4"""
    return cards.join(state, "card_id", "left_anti")


def cascade_delete(projects: DataFrame, materials: DataFrame, cards: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left when the projects in gone(id) go: children lose their parent, materials and cards of the project go."""
    left = projects.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("parent_project_id"), F.lit(1).alias("_g")), "parent_project_id", "left")
    left = left.withColumn("parent_project_id", F.when(F.col("_g").isNull(), F.col("parent_project_id"))).select(projects.columns)
    of = gone.withColumnRenamed("id", "project_id")
    return left, materials.join(of, "project_id", "left_anti"), cards.join(of, "project_id", "left_anti")


def clone_id(old: Column, clone: str) -> Column:
    return F.sha2(F.concat_ws("|", old.cast("string"), F.lit(clone)), 256)


def clone_project(materials: DataFrame, cards: DataFrame, project: str, clone: str) -> tuple[DataFrame, DataFrame]:
    """A project's materials and cards under new ids; cards follow their materials, verification and reviews start anew."""
    m = materials.where(F.col("project_id") == project)
    ids = m.select(F.col("id").alias("source_material_id"), clone_id(F.col("id"), clone).alias("_new"))
    new_m = m.withColumns({"id": clone_id(F.col("id"), clone), "project_id": F.lit(clone), "source_mtime": F.lit(None).cast("long")})
    c = cards.where(F.col("project_id") == project).join(ids, "source_material_id", "left")
    new_c = c.withColumns({"card_id": clone_id(F.col("card_id"), clone), "project_id": F.lit(clone), "source_material_id": F.col("_new"), "user_verified": F.lit(False), "due_at": F.lit(None).cast("long")})
    return new_m, new_c.drop("_new")


def replace_cards(old: DataFrame, new: DataFrame) -> DataFrame:
    """A project's cards give way only where there are new ones."""
    return old.join(new.select("project_id").distinct(), "project_id", "left_anti").unionByName(new)


def batch_flags(cards: DataFrame, ids: DataFrame, flag: str, value: bool, now: int) -> DataFrame:
    """Sets a flag of the listed cards."""
    hit = cards.join(ids.select("card_id", F.lit(1).alias("_h")).distinct(), "card_id", "left")
    return hit.withColumns({flag: F.when(F.col("_h") == 1, F.lit(value)).otherwise(F.col(flag)), "updated_at": F.when(F.col("_h") == 1, F.lit(now)).otherwise(F.col("updated_at"))}).drop("_h")


def edit_cards(cards: DataFrame, patches: DataFrame) -> DataFrame:
    """Non-null fields of patches(card_id, title, summary, details), trimmed and cut."""
    p = patches.withColumnsRenamed({f: f"_{f}" for f in ("title", "summary", "details")})
    sizes = {"title": 100, "summary": 300, "details": 2000}
    rows = cards.join(p, "card_id", "left")
    return rows.withColumns({f: F.coalesce(F.substring(js_trim(F.col(f"_{f}")), 1, n), F.col(f)) for f, n in sizes.items()}).select(cards.columns)


def backfill_category(materials: DataFrame) -> DataFrame:
    """U6"""
    return materials.withColumn("category", F.when((F.col("type") == "company_url") & (F.col("category") == "project"), "company").otherwise(F.col("category")))


def scope_facets(notes: DataFrame) -> DataFrame:
    """A1: notes(project_id, folder, tags) -> counts by folder and by tag; a tag counts once a note."""
    by = lambda kind, c, df: df.groupBy("project_id", F.lit(kind).alias("kind"), c.alias("name")).agg(F.count("*").alias("n"))
    tags = notes.select("project_id", F.explode(F.array_distinct("tags")).alias("t"))
    rows = by("folder", F.col("folder"), notes).unionByName(by("tag", F.col("t"), tags))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("project_id", "kind").orderBy(F.desc("n"), "name")))


def scan_summary(notes: DataFrame) -> DataFrame:
    """A2: notes(project_id, status)"""
    return notes.groupBy("project_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "unchanged")])


class _Names:
    """Names taken so far, without case, and the suffix from which on each is free."""

    def __init__(self):
        self.used, self.next = set(), {}

    def take(self, card_id, name: str | None, low: str | None) -> list[tuple]:
        if name is None:
            return [(card_id, None)]
        if low not in self.used:
            self.used.add(low)
            return [(card_id, name)]
        i = self.next.get(low, 2)
        while f"{low} {i}" in self.used:
            i += 1
        self.used.add(f"{low} {i}")
        self.next[low] = i + 1
        return [(card_id, f"{name} {i}")]

    def close(self) -> list[tuple]:
        return []


def unique_filenames(cards: DataFrame, order: str = "place", name: str = "name") -> DataFrame:
    """In export order, names taken already (without case) get the first free suffix ` 2`, ` 3`, ..; a null name stays null.

    One fold per project over its export, linear in it; a task holds the names of one project.
    """
    kinds = dict(cards.dtypes)
    return fold_sorted(cards, "project_id", [order, "card_id"], ["card_id", name, F.lower(name)], _Names, f"project_id {kinds['project_id']}, card_id {kinds['card_id']}, filename string")
