"""Tables grouped and found by alike titles and row labels: similarity joins with exact checks, leaders chosen in parallel rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.functions import label as labels_
from filingloom.operators.shared import cut

#: Least ratio of titles and least share of common labels.
LEAST = 0.8
#: Tables of each structure that the first round decides; later rounds take four times as many.
FIRST_ROUND = 256


def usable_labels(items: Column) -> Column:
    """The distinct labels by which tables are compared, sorted; null where a table has none at all, empty where none is usable."""
    plain = F.array_sort(F.array_distinct(F.filter(F.transform(items, labels_.grouping), lambda x: ~x.isin("", "nan", "none", "row label"))))
    return F.when(F.size(items) > 0, plain)


def label_overlap(a: Column, b: Column) -> Column:
    """Share of common ``usable_labels``; 1 if either table has no labels at all."""
    return F.when(a.isNull() | b.isNull(), 1.0).otherwise(labels_.jaccard(a, b))


def merge_scores(title: Column, other_title: Column, rows: Column, other_rows: Column, pattern: Column, other_pattern: Column, least: float = LEAST) -> Column:
    """(merge, title_similarity, row_overlap, pattern_match): whether two tables merge; a score behind the first that fails is 0 or false."""
    alike = labels_.similarity(title, other_title)
    mine, theirs = usable_labels(rows), usable_labels(other_rows)
    overlap = F.when(alike >= least, F.coalesce(labels_.jaccard(mine, theirs), F.lit(0.0))).otherwise(0.0)

    def scores(s: Column) -> Column:
        same = (s["overlap"] >= least) & F.coalesce(pattern == other_pattern, F.lit(False))
        return F.struct(same.alias("merge"), s["alike"].alias("title_similarity"), s["overlap"].alias("row_overlap"), same.alias("pattern_match"))

    # As a lambda's argument, so that the labels are not compared anew for each score.
    return F.transform(F.array(F.struct(alike.alias("alike"), overlap.alias("overlap"))), scores)[0]


def _grams(titles: DataFrame) -> DataFrame:
    """Numbered bigrams of each title, with marks before and behind it: ``key, title, gram, nth, chars``."""
    chars = titles.select("key", "title", F.split(F.concat(F.lit("\x02"), F.col("title"), F.lit("\x03")), "").alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.concat(F.get("c", i), F.get("c", i + 1)))
    each = chars.select("key", "title", (F.size("c") - 2).alias("chars"), F.posexplode(pairs).alias("at", "gram"))
    nth = F.row_number().over(Window.partitionBy("key", "title", "gram").orderBy("at"))
    return each.select("key", "title", "chars", "gram", nth.alias("nth"))


def _prefix(grams: DataFrame, rarity: DataFrame, least: float) -> DataFrame:
    """The rarest bigrams of each title, as many as any partner must share one of."""
    rare_first = Window.partitionBy("key", "title").orderBy("df", "gram", "nth")
    # A partner has chars * least / (2 - least) characters at least, and then so many bigrams in common.
    common = (1.5 * least - 1) * 2 / (2 - least) * F.col("chars") + 1
    ranked = grams.join(rarity, ["key", "gram", "nth"]).withColumn("rank", F.row_number().over(rare_first))
    return ranked.where(F.col("rank") <= F.floor(F.col("chars") + 2 - common + 1e-9)).select("key", "title", "chars", "gram", "nth")


def title_pairs(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """Titles of ``left`` and ``right`` (columns ``key``, ``title``; distinct) under one key whose matching-blocks ratio is ``least`` or more: ``key, title, of, ratio``.

    Matching blocks are a common subsequence of M characters, and the ratio is
    2M / (a + b) for lengths a and b. A character that is not matched breaks two
    bigrams of its own title and one of the other, so titles have
    (1.5 least - 1)(a + b) + 1 numbered bigrams in common, the marks at their ends included.
    So they share one among the rarest of each (prefix filter), and only such pairs are measured.
    ``least`` must be over 2/3.
    """
    if least <= 2 / 3:
        raise ValueError("the bound by bigrams holds for ratios over 2/3")
    mine, theirs = _grams(left), _grams(right)
    both = mine.select("key", "gram", "nth").unionByName(theirs.select("key", "gram", "nth"))
    rarity = both.groupBy("key", "gram", "nth").agg(F.count("*").alias("df"))
    a = _prefix(mine, rarity, least)
    b = _prefix(theirs, rarity, least).select("key", "gram", "nth", F.col("title").alias("of"), F.col("chars").alias("other"))
    shorter, longer = F.least("chars", "other"), F.greatest("chars", "other")
    near = a.join(b, ["key", "gram", "nth"]).where(2 * shorter >= least * (shorter + longer) - 1e-9).select("key", "title", "of").distinct()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for batch in batches:
            # A matcher indexes its second text, so pairs come by that.
            matcher, last, ratios = SequenceMatcher(None), None, []
            for a, b in zip(batch["title"], batch["of"], strict=True):
                if b != last:
                    matcher.set_seq2(b)
                    last = b
                matcher.set_seq1(a)
                ratios.append(matcher.ratio() if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least else 0.0)
            yield batch.assign(ratio=ratios)[[r >= least for r in ratios]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.schema.fields) + ", ratio double"
    return near.repartition("key", "of").sortWithinPartitions("of").mapInPandas(measure, schema)


#: Stand for tables without labels: what an item with labels, and what one without looks for among leaders.
_BARE, _ANY = "\x02bare", "\x02any"


def _matches(items: DataFrame, leaders: DataFrame, least: float) -> DataFrame:
    """``item``, ``leader``, ``score`` of each item and each other leader that takes it in if it came before."""
    pairs = title_pairs(items.select("key", "title").distinct(), leaders.select("key", "title").distinct(), least)
    n = F.size("labels")
    head = F.slice("labels", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))
    ask = F.when(F.col("labels").isNull(), F.array(F.lit(_ANY))).otherwise(F.concat(head, F.array(F.lit(_BARE))))
    offer = F.when(F.col("labels").isNull(), F.array(F.lit(_ANY), F.lit(_BARE))).otherwise(F.concat(head, F.array(F.lit(_ANY))))
    a = items.select("item", "key", "title", "labels", F.explode(ask).alias("token")).join(pairs, ["key", "title"])
    b = leaders.select(F.col("item").alias("leader"), "key", F.col("title").alias("of"), F.col("labels").alias("theirs"), F.explode(offer).alias("token"))
    share = label_overlap(F.col("labels"), F.col("theirs"))
    met = a.join(b, ["key", "of", "token"]).where("item != leader").withColumn("share", share).where(F.col("share") >= least)
    return met.select("item", "leader", ((F.col("ratio") + F.col("share")) / 2).alias("score")).distinct()


def _firsts(batch: DataFrame, least: float) -> DataFrame:
    """Those of a batch that no earlier leader of the batch takes in: each pass decides all that wait for nobody."""
    first = batch.select("item", "first")
    links = _matches(batch, batch, least).join(first, "item").join(first.select(F.col("item").alias("leader"), F.col("first").alias("before")), "leader")
    links = cut(links.where("before < first").select("item", "leader"))
    open_, chosen = cut(first.select("item")), None
    while not open_.isEmpty():
        new = cut(open_.join(links.select("item").distinct(), "item", "left_anti"))
        chosen = new if chosen is None else chosen.unionByName(new)
        taken = links.join(new.select(F.col("item").alias("leader")), "leader", "left_semi").select("item").distinct()
        open_ = cut(open_.join(new, "item", "left_anti").join(taken, "item", "left_anti"))
        links = links.join(open_, "item", "left_semi").join(open_.select(F.col("item").alias("leader")), "leader", "left_semi")
        links = cut(links)
    return batch if chosen is None else batch.join(chosen, "item", "left_semi")


def _leaders(items: DataFrame, least: float) -> DataFrame:
    """Items that start a group. A round takes the next items of each structure, chooses among them, and lets go all later ones that those take in."""
    rest, size, found = items, FIRST_ROUND, items.where("false")
    while not rest.isEmpty():
        # The rank limit is taken by each task before its shuffle.
        rank = F.row_number().over(Window.partitionBy("key").orderBy("first"))
        now = rest.select("item", "key", "first").withColumn("n", rank).where(F.col("n") <= size).select("item")
        batch = cut(rest.join(now, "item", "left_semi"))
        new = cut(_firsts(batch, least))
        later = cut(rest.join(batch.select("item"), "item", "left_anti"))
        found = found.unionByName(new)
        if later.isEmpty():
            break
        rest = cut(later.join(_matches(later, new, least).select("item").distinct(), "item", "left_anti"))
        size *= 4
    return cut(found)


def fuzzy_groups(tables: DataFrame, at: str, key: str, title: str, row_labels: str, least: float = LEAST) -> DataFrame:
    """``group`` and ``score`` of tables taken in the order of ``at`` (numbers, each once).

    A table joins the group whose first table has the same ``key``, a title of a
    ratio of ``least`` or more and so large a share of common labels (not asked if
    either has no labels); of several that with the best mean of both, then the earliest. If
    there is none it starts a group, named by its ``at``, with a null score.

    Equal tables are one item. Who starts a group is settled in rounds, each over
    similarity joins with the starters alone; a family of alike titles meets its
    starter and not itself. Then every item meets all starters, and each table
    takes the best of those before it.

    Null keys, titles and labels count as empty; a table whose labels are all unusable
    fits groups without labels only, not even tables equal to it. An empty table gives no rows; other columns pass through.
    """
    rows = tables.withColumns({
        "_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "_title": F.lower(F.trim(F.coalesce(F.col(title), F.lit("")))), "_labels": usable_labels(F.col(row_labels)),
    })
    rows = rows.withColumn("_item", F.sha2(F.to_json(F.struct("_key", "_title", "_labels")), 256))
    items = rows.groupBy(F.col("_item").alias("item")).agg(
        F.first("_key").alias("key"), F.first("_title").alias("title"), F.first("_labels").alias("labels"), F.min(at).alias("first")
    )
    items = cut(items)
    # Labels rarest first, so that what items meet under is rare.
    each = items.select("item", F.explode("labels").alias("l"))
    rare = each.join(each.groupBy("l").agg(F.count("*").alias("df")), "l").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("df", "l"))).alias("s"))
    by_rarity = F.when(F.size("labels") > 0, F.transform("s", lambda x: x["l"])).otherwise(F.col("labels"))
    items = cut(items.join(rare, "item", "left").withColumn("labels", by_rarity).drop("s"))
    leaders = _leaders(items, least)
    itself = leaders.where("labels IS NULL OR size(labels) > 0").select("item", F.col("item").alias("leader"), F.lit(1.0).alias("score"))
    found = _matches(items, leaders, least).unionByName(itself)
    found = found.join(leaders.select(F.col("item").alias("leader"), "first"), "leader")
    best = cut(found.groupBy("item").agg(F.collect_list(F.struct("score", (-F.col("first")).alias("back"))).alias("_found")))
    joined = rows.join(best.withColumnRenamed("item", "_item"), "_item", "left")
    own = F.array_max(F.filter("_found", lambda x: -x["back"] < F.col(at)))
    return joined.select(*tables.columns, F.coalesce(-own["back"], F.col(at)).alias("group"), own["score"].alias("score"))


def find_tables(tables: DataFrame, titles: DataFrame, title: str, year: str, quarter: str, order: str, years: list[int] | None = None, quarters: list[str] | None = None, least: float = LEAST) -> DataFrame:
    """Tables with a title like one asked for (``wanted`` of ``titles``): the best of each year and quarter, with its ``ratio``.

    ``years`` and ``quarters`` (one contained in the other, in any case) limit them; of equal ratios the smallest ``order`` wins.
    Rows come without order; sort them by year and quarter.
    """
    plain = F.lower(F.col(title))
    kept = tables.where(F.coalesce(F.col(title), F.lit("")) != "")
    if years:
        kept = kept.where(F.col(year).isin(years))
    if quarters:
        upper = F.upper(F.coalesce(F.col(quarter), F.lit("")))
        kept = kept.where(F.greatest(F.lit(False), *[F.contains(upper, F.lit(q.upper())) | F.contains(F.lit(q.upper()), upper) for q in quarters]))
    kept = kept.withColumn("_t", plain)
    asked = titles.select("wanted", F.lower("wanted").alias("_of")).where("wanted != ''")
    one = lambda df, c: df.select(F.lit(0).alias("key"), F.col(c).alias("title")).distinct()
    near = title_pairs(one(kept, "_t"), one(asked, "_of"), least).select(F.col("title").alias("_t"), F.col("of").alias("_of"), "ratio")
    hits = kept.join(near, "_t").join(asked, "_of")
    best = F.row_number().over(Window.partitionBy("wanted", year, quarter).orderBy(F.desc("ratio"), order))
    return hits.withColumn("_n", best).where("_n = 1").select("wanted", *tables.columns, "ratio")
