"""Rules of upkeep and of writes: pending vectors, origins, boundaries, decay, growth, routing, checked proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import hashing, text
from palimpsest.operators import entities, queues

#: Kinds of relation that a proposal may have: fixed values.
RELATIONS = ("CAUSES", "ENABLES", "PRECEDES", "CONTRADICTS", "SIMILAR", "RELATED_TO", "ANALOGOUS_TO")
_PAYLOAD = "entities array<struct<name string, type string, aliases array<string>, is_speaker boolean>>"


def pending_vectors(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, missing): texts that aren't blank and whose vector is missing or was made of another text (FLT-8).

    texts: id, text. vectors: id, text_hash (MD5 of the text that was embedded; a null one counts as another's).
    """
    now = F.md5(F.col("text").cast("binary"))
    t = texts.filter(F.trim("text") != "").select("id", now.alias("now")).join(vectors.select("id", "text_hash", F.lit(True).alias("has")), "id", "left")
    return t.filter(~F.col("now").eqNullSafe(F.col("text_hash"))).select("id", F.col("has").isNull().alias("missing"))


def origins(routes: DataFrame, keys: list[str], session: int) -> DataFrame:
    """keys, own, other: whether an item comes from the asking session, and whether from another one (FLT-12).

    routes: keys, session: every session that an item's provenance names. One without a session counts as another's.
    """
    own = F.col("session").eqNullSafe(F.lit(session))
    return routes.groupBy(*keys).agg(F.bool_or(own).alias("own"), F.bool_or(~own).alias("other"))


def mid_session(turns: DataFrame, covered: DataFrame, most: int = 12, gap_us: int = 600_000_000) -> DataFrame:
    """(session, uncovered, boundary): sessions due for a narrative before they end (STR-S3).

    A boundary is crossed if most turns aren't covered yet, or if some aren't and the last two are gap_us apart.
    turns: session, at, seq. covered: session, covered (turns that the standing narrative holds). The last two turns
    are found by two aggregations, so that no session is sorted.
    """
    at = F.struct("at", "seq")
    last = turns.groupBy("session").agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    before = turns.join(last.select("session", "last"), "session").filter(at < F.col("last")).groupBy("session").agg(F.max("at").alias("before"))
    s = last.join(before, "session", "left").join(covered, "session", "left")
    gap = F.coalesce(F.unix_micros("last.at") - F.unix_micros("before"), F.lit(0))
    uncovered = F.col("n") - F.coalesce("covered", F.lit(0))
    return s.select("session", uncovered.alias("uncovered"), ((uncovered >= most) | ((uncovered > 0) & (gap >= gap_us))).alias("boundary"))


def identifier_decay(names: DataFrame, mentions: DataFrame, protected: DataFrame, now: Column, most: int = 5, idle_days: int = 7) -> DataFrame:
    """(id, shape, k): identifiers that few episodes mention, none of late, and that nothing protects (OP-8).

    names: id, name. mentions: id, at, one row an episode; names without any stay. protected: id, of entities with a
    typed edge or that others were merged into.
    """
    m = mentions.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.max("at").alias("last"))
    m = m.filter((F.col("k") <= most) & (F.col("last") <= now - F.make_dt_interval(F.lit(idle_days))))
    shaped = names.withColumn("shape", text.identifier_shape(F.col("name"))).filter("shape is not null")
    return shaped.join(m, "id").join(protected.select("id"), "id", "left_anti").select("id", "shape", "k")


def outgrown(mentions: DataFrame, baselines: DataFrame, least: int = 5) -> DataFrame:
    """(id, k, baseline): entities mentioned least times or more beyond the count their description was made at (OP-12).

    mentions: id, one row an episode. baselines: id, baseline; without one it is 0.
    """
    m = mentions.groupBy("id").agg(F.count(F.lit(1)).alias("k")).join(baselines, "id", "left").na.fill(0, ["baseline"])
    return m.filter(F.col("k") - F.col("baseline") >= least).select("id", "k", "baseline")


def second_signals(pairs: DataFrame, mentions: DataFrame, both: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, seconds): nominated pairs with another sign that they belong together, and which signs (OP-22).

    pairs: a, b. mentions: episode, entity. both: node, other, both ways. names: id, name. Names count if they are equal
    when folded or squashed; a similar spelling alone is no second sign.
    """

    def shared(rows: DataFrame, end: str, by: str, sign: str) -> DataFrame:
        x, y = rows.select(F.col(end).alias("a"), by), rows.select(F.col(end).alias("b"), by)
        return pairs.select("a", "b").join(x, "a").join(y, ["b", by], "left_semi").select("a", "b", F.lit(sign).alias("sign"))

    squashed = text.squash(text.fold_ascii(F.col("name")))
    n = names.filter(squashed != "").select("id", squashed.alias("form"))
    same = pairs.select("a", "b").join(n.select(F.col("id").alias("a"), "form"), "a").join(n.select(F.col("id").alias("b"), "form"), ["b", "form"], "left_semi")
    found = shared(mentions, "entity", "episode", "shared_episode").unionByName(shared(both, "node", "other", "shared_neighbor")).unionByName(same.select("a", "b", F.lit("name_overlap").alias("sign")))
    return found.groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_set("sign")), ",").alias("seconds"))


def checked_relations(proposals: DataFrame, known: DataFrame, types: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(episode, type, source, target, quote): proposed relations that hold up (WR-18).

    Kept are those of a known type between two different known entities whose quote stands in the episode's text word
    for word; of repeated ones of an episode, one with the least quote. proposals: episode, text, type, source, target,
    quote. known: id.
    """
    kind, quote = F.upper(F.trim("type")), F.trim("quote")
    p = proposals.select("episode", "text", kind.alias("type"), "source", "target", quote.alias("quote"))
    p = p.filter(F.col("type").isin(*types) & (F.col("source") != F.col("target")) & (F.col("quote") != "") & F.col("text").contains(F.col("quote")))
    for end in ("source", "target"):
        p = p.join(known.select(F.col("id").alias(end)), end, "left_semi")
    return p.groupBy("episode", "type", "source", "target").agg(F.min("quote").alias("quote"))


def extracted_entities(payloads: DataFrame, types: tuple[str, ...], fallback: str = "topic", most: int = 20, longest: int = 120, aliases: int = 8) -> DataFrame:
    """(id, name_norm, name, types, aliases, is_speaker): entities of extraction payloads, one row a name (WR-19).

    payloads: id, payload (JSON). Payloads that aren't extractions give no rows. Names are collapsed; empty and too long
    ones go. Rows of one folded name are absorbed into its first: their types (unknown ones are the fallback) and
    aliases are united, and it is the speaker if one of them is. The first most names of a payload stay.
    """
    rows = payloads.select("id", F.posexplode(F.from_json("payload", _PAYLOAD)["entities"]).alias("place", "e"))
    name = F.trim(F.regexp_replace("e.name", r"\s+", " "))
    rows = rows.select("id", "place", name.alias("name"), F.when(F.col("e.type").isin(*types), F.col("e.type")).otherwise(fallback).alias("type"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("e.is_speaker", F.lit(False)).alias("is_speaker"))
    rows = rows.filter(F.length("name").between(1, longest)).withColumn("name_norm", text.fold_ascii(F.col("name")))
    one = rows.groupBy("id", "name_norm").agg(F.min("place").alias("place"), F.min_by("name", "place").alias("name"), F.sort_array(F.collect_set("type")).alias("types"), F.flatten(F.collect_list("aliases")).alias("held"), F.bool_or("is_speaker").alias("is_speaker"))
    folded = F.array_sort(F.array_distinct(F.transform("held", text.fold_ascii)))
    one = one.withColumn("aliases", F.slice(F.filter(folded, lambda x: (x != "") & (x != F.col("name_norm"))), 1, aliases))
    # a payload's names are few, and their places tell which came first
    places = one.groupBy("id").agg(F.sort_array(F.collect_list("place")).alias("places"))
    kept = one.join(places, "id").filter((F.size("places") <= most) | (F.col("place") <= F.try_element_at("places", F.lit(most))))
    return kept.select("id", "name_norm", "name", "types", "aliases", "is_speaker")


def route(names: DataFrame, structural: DataFrame, owned: DataFrame, aliases: DataFrame, speaker: str) -> DataFrame:
    """names, tier, entity: the identity that each extracted name lands on (WR-22).

    The speaker first; then a structural identity of that name; then the identity whose own name it is; then the single
    holder of the alias (several holders are a question for the dedup, not for a write); else a new identity, whose id
    is derived from the name. names: name_norm, is_speaker and others. structural, owned: name_norm, id. aliases:
    alias, holder. ids are strings.
    """

    def least(rows: DataFrame, tier: str) -> DataFrame:
        return rows.groupBy("name_norm").agg(F.min("id").alias(tier))

    alias = entities.unique_alias_holders(aliases).select(F.col("alias").alias("name_norm"), F.col("holder").alias("alias"))
    n = names.join(least(structural, "structural"), "name_norm", "left").join(least(owned, "name"), "name_norm", "left").join(alias, "name_norm", "left")
    tiers = [("speaker", F.when(F.col("is_speaker"), F.lit(speaker))), *((t, F.col(t)) for t in ("structural", "name", "alias"))]
    tier = F.coalesce(*[F.when(c.isNotNull(), t) for t, c in tiers], F.lit("new"))
    entity = F.coalesce(*[c for _, c in tiers], hashing.derived_id(F.lit("entity"), F.col("name_norm")))
    return n.withColumns({"tier": tier, "entity": entity}).drop("structural", "name", "alias")


def vector_age(nodes: DataFrame, vectors: DataFrame, touches: DataFrame) -> DataFrame:
    """(id, state): fresh, stale or missing context vectors (WR-26).

    A vector is stale if its node's edges were touched after it was made. nodes: id. vectors: id, made. touches: id, at.
    """
    last = touches.groupBy("id").agg(F.max("at").alias("last"))
    n = nodes.select("id").join(vectors.select("id", "made"), "id", "left").join(last, "id", "left")
    return n.select("id", F.when(F.col("made").isNull(), "missing").when(F.col("last") > F.col("made"), "stale").otherwise("fresh").alias("state"))


def trigger_after(said: Column) -> Column:
    """The moment that an intention waits for, or null where what was said isn't a date (WR-31)."""
    return F.try_to_timestamp(F.nullif(F.trim(said), F.lit("")))


def validated(answers: DataFrame) -> DataFrame:
    """(id, status, restated): the answer that a restatement check ends with (WR-31).

    An unusable first answer is asked for once more; a failed call isn't. answers: id, attempt (0 or 1), status
    (answered, unusable, failed), restated. Without a second answer the first one stands.
    """
    first, second = (F.max_by(F.struct("status", "restated"), F.when(F.col("attempt") == i, F.lit(1))).alias(n) for i, n in enumerate(("first", "second")))
    a = answers.groupBy("id").agg(first, second)
    end = F.when((F.col("first.status") == "unusable") & F.col("second").isNotNull(), F.col("second")).otherwise(F.col("first"))
    return a.select("id", end.alias("end")).select("id", "end.status", F.when(F.col("end.status") == "answered", F.col("end.restated")).alias("restated"))


def narratives(turns: DataFrame, most: int) -> DataFrame:
    """Narratives of conversations by version (WR-27): conv_id, version, chunk, body, first_turn, last_turn, turns, id, superseded.

    turns: conv_id, version, turn, text; a version covers the turns it has. Turns are cut into even chunks of most at most,
    each becomes the first lines of its turns, which is all it may say, under an id of its content. Only a
    conversation's newest version isn't superseded.
    """
    keyed = turns.withColumn("of", F.struct("conv_id", "version"))
    cut = queues.balanced_chunks(keyed, "of", "turn", most).select("of.conv_id", "of.version", "turn", "chunk").join(turns, ["conv_id", "version", "turn"])
    lines = F.sort_array(F.collect_list(F.struct("turn", F.substring_index("text", "\n", 1).alias("line"))))
    n = cut.groupBy("conv_id", "version", "chunk").agg(F.array_join(F.transform(lines, lambda x: x["line"]), " / ").alias("body"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("turns"))
    newest = turns.groupBy("conv_id").agg(F.max("version").alias("newest"))
    n = n.join(newest, "conv_id")
    return n.select("conv_id", "version", "chunk", "body", "first_turn", "last_turn", "turns", hashing.derived_id(F.col("conv_id"), F.col("version"), F.col("chunk"), F.col("body")).alias("id"), (F.col("newest") > F.col("version")).alias("superseded"))
