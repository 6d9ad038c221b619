"""Rebuilding conversations from message rows.

Method: the rows are an event log. All rows of one message (its deliveries, retries, edits, deletion) are folded by
version into one turn; turns are given their thread, ordered and validated.

* Rows are combined once, by identifiers; what ``memloom.operators.copies`` finds from shared identifiers tells which of these
  combinations are one message, and only those are folded once more.
* A turn without a thread takes that of the turn it replies to, through as many turns as it takes (pointer doubling over
  the turns without a thread only).
* A chain of replies that never ends must, somewhere, go from a turn to a later one. So only conversations with such a
  reply can hold one, and only their replies are followed, again by pointer doubling. No conversation is collected anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.keys import clean_id
from memloom.functions.values import ROLE_ALIASES, mapped
from memloom.operators.copies import close_links, combinations, id_rows, mark_linked, packed, scope_id
from memloom.operators.ranks import positions
from memloom.staging import drop, stage

#: Message types that take a message back (parameter of ``fold_turns``).
DELETIONS = ("delete", "deleted", "recall", "recalled", "retract", "retracted")
#: Fixed value: a character that shows. White space, controls, format characters, fillers and variation selectors do not.
VISIBLE = r"(?U)[^\s\p{C}\p{Z}\x{034f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{2800}\x{3164}\x{fe00}-\x{fe0f}\x{ffa0}\x{e0100}-\x{e01ef}]"


def role(actor: Column | str) -> Column:
    """Trimmed lower-case role without aliases; blank is system."""
    c = F.lower(F.coalesce(clean_id(actor), F.lit("system")))
    return mapped(c, ROLE_ALIASES, c)


def shows(text: Column) -> Column:
    return F.coalesce(text.rlike(VISIBLE), F.lit(False))


def shown_text(text: str = "text", parts: str = "parts") -> Column:
    """``text`` if it shows anything, else the distinct showing texts of ``parts`` by line; null if nothing shows."""
    texts = F.filter(F.transform(F.col(parts), lambda p: p.text), shows)
    of_parts = F.nullif(F.array_join(F.array_distinct(texts), "\n"), F.lit(""))
    return F.when(shows(F.col(text)), F.col(text)).otherwise(of_parts)


def fold_turns(messages: DataFrame, with_text: bool = True, deletions: Sequence[str] = DELETIONS) -> DataFrame:
    """One turn for each message: scope_id, turn, name, by_event, main, at, thread, reply, root, role, shows (and said).

    ``turn`` is the kept row's delivery_id; ``name`` what replies call it: its message id, or its event id if no copy has
    a message id (``by_event``; null if it has neither). Versions follow each other by ``at``; of one time, a deletion counts as
    later, then the greater delivery_id. ``said`` is the delivery_id of the last version that shows text, ``at`` the time of the
    first version, so that an edited turn keeps its place; a message whose last version is a deletion shows nothing.
    Ids and roles do not change between versions; should copies disagree, the greatest counts. A turn with several
    message ids has one row for each, alike but for ``name`` and ``main``, which is true in one of them.

    Rows are combined by all their ids, thread and role, on which copies agree. So everything that is folded is a number, and
    Spark aggregates by hash, before its one shuffle and after it. Only messages with several combinations are folded again.
    """
    gone = F.coalesce(F.lower(clean_id("message_type")).isin(*deletions), F.lit(False))
    in_parts = F.exists(F.coalesce(F.transform("parts", lambda p: p.text), F.array().cast("array<string>")), shows)
    more = [
        clean_id("thread_id").alias("thread"),
        clean_id("reply_to_id").alias("reply"),
        clean_id("thread_root_id").alias("root"),
        F.when(clean_id("actor").isNotNull(), role("actor")).alias("role"),
        F.when(shows(F.col("text")), True).otherwise(in_parts).alias("shown"),
        F.col("at"),
        # Twice the microseconds, and one more for a deletion; a null time comes first.
        (F.coalesce(F.unix_micros("at"), F.lit(-(1 << 58))) * 2 + gone.cast("long")).alias("v"),
    ]
    names, words = ["id0", "id1"], ["thread", "reply", "root", "role"]
    rows = id_rows(messages, "scope_key", ["message_id", "event_id"], "received_at", "delivery_id", *more)
    said, said_order = F.when(F.col("shown"), F.col("key")), packed(F.shiftright("v", 1), F.col("key"))
    folds = [F.min("at").alias("at"), F.max("v").alias("v"), F.max("shown").alias("shown")]
    if with_text:
        folds += [F.max_by(said, F.when(F.col("shown"), said_order)).alias("said"), F.max(F.when(F.col("shown"), F.col("v"))).alias("said_v")]
    # A message without ids is a combination of its own.
    solo = F.when((F.col("id0") == "") & (F.col("id1") == ""), F.col("key"))
    nodes = stage(combinations(rows.withColumn("solo", solo), ["scope_id", *names, *words, "solo"], *folds).drop("solo"))
    marked = mark_linked(nodes, names)
    drop(nodes)
    kept = ["at", "v", "shown", *words, *(["said"] if with_text else [])]
    name = F.coalesce(F.nullif("id0", F.lit("")), F.nullif("id1", F.lit("")))
    settled = marked.where("label is null").select("scope_id", F.col("node").alias("turn"), name.alias("name"), (F.col("id0") == "").alias("by_event"), F.lit(True).alias("main"), *kept)

    linked = marked.where("label is not null").join(close_links(marked, names).hint("shuffle_hash"), "node").withColumnRenamed("keeper", "turn")
    again = [F.min("at").alias("at"), F.max("v").alias("v"), F.max("shown").alias("shown"), *[F.max(c).alias(c) for c in words], F.first("scope_id").alias("scope_id")]
    if with_text:
        again.append(F.max_by("said", packed(F.shiftright("said_v", 1), F.col("said"))).alias("said"))
    whole = linked.groupBy("turn").agg(F.max(F.col("id0") != "").alias("has_id"), *again)
    called = linked.select("turn", *names).join(whole, "turn").withColumn("name", F.when(F.col("has_id"), F.nullif("id0", F.lit(""))).otherwise(F.col("id1")))
    called = called.where("name is not null").groupBy("turn", "name").agg(F.first(~F.col("has_id")).alias("by_event"), *[F.first(c).alias(c) for c in ("scope_id", *kept)])
    called = called.withColumn("main", F.row_number().over(Window.partitionBy("turn").orderBy("name")) == 1)

    turns = settled.unionByName(called.select(*settled.columns))
    shows_now = F.col("shown") & (F.col("v") % 2 == 0)
    out = turns.select("scope_id", "turn", "name", "by_event", "main", "at", "thread", "reply", "root", F.coalesce("role", F.lit("system")).alias("role"), shows_now.alias("shows"), *(["said"] if with_text else []))
    out.built_on = marked
    return out


def assign_threads(turns: DataFrame) -> DataFrame:
    """One row for each turn: ``turns`` with ``thread`` completed and, of the turn its reply names, ``target``, ``target_thread`` and ``target_at``.

    What ``turns`` was staged in is deleted once it has been read; they can't be used afterwards.
    """
    main = turns.where("main").drop("main", "name", "by_event")
    # A name is that of one message id, or of one event id; should a reply's be both, the turn with the lesser number is meant.
    # Either side's rows are hashed by the name; a name that is often replied to is split on the other side.
    replying = main.where("reply is not null")
    for n, events in enumerate((False, True)):
        names = turns.where("name is not null").where(F.col("by_event") == events)
        names = names.select("scope_id", F.col("name").alias("reply"), F.col("turn").alias(f"t{n}"), F.col("thread").alias(f"h{n}"), F.col("at").alias(f"a{n}"))
        replying = replying.join(names.hint("shuffle_hash"), ["scope_id", "reply"], "left")
    first = F.coalesce(F.col("t0") <= F.col("t1"), F.col("t0").isNotNull())
    either = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    replying = replying.select(*main.columns, either("t0", "t1").alias("target"), either("h0", "h1").alias("target_thread"), either("a0", "a1").alias("target_at"))
    silent = main.where("reply is null").select(*main.columns, F.lit(None).cast("long").alias("target"), F.lit(None).cast("string").alias("target_thread"), F.lit(None).cast("timestamp").alias("target_at"))
    calls = stage(turns.where("thread is null and name is not null").select("scope_id", F.col("name").alias("root"), "turn"))
    linked = stage(replying.unionByName(silent))
    drop(getattr(turns, "built_on", None))

    loose = linked.where("thread is null")
    # Distinct first, as a thread gives its root in all its messages; only roots that are asked for are compared further.
    rooted = linked.where("thread is not null and root is not null").groupBy("scope_id", "root", "thread").agg(F.lit(1).alias("_"))
    of_root = calls.join(rooted, ["scope_id", "root"]).groupBy("turn").agg(F.min("thread").alias("root_thread"))
    # A turn that replies to nothing known falls back on its root at once; the others after their replies.
    found = stage(
        loose.join(of_root, "turn", "left").select(
            "turn",
            F.coalesce("target_thread", F.when(F.col("target").isNull(), F.col("root_thread"))).alias("thread"),
            F.when(F.col("target_thread").isNull(), F.col("target")).alias("next"),
            "root_thread",
        )
    )
    settled, left = _follow(found)
    if left is not None and left.where("root_thread is not null").limit(1).count():
        # What no reply leads to a thread takes its root's, and hands it on along the replies.
        again = left.join(found.select("turn", F.col("next").alias("_next")), "turn").select("turn", F.col("root_thread").alias("thread"), F.when(F.col("root_thread").isNull(), F.col("_next")).alias("next"), "root_thread")
        more, _ = _follow(stage(again))
        settled = settled.unionByName(more)
    done = settled.select("turn", F.col("thread").alias("late_thread"))
    # Only turns that had no thread, and turns that reply to such a turn, are touched by what was found.
    late_target = done.select(F.col("turn").alias("target"), F.col("late_thread").alias("target_late"))
    is_open = F.col("thread").isNull() | (F.col("target").isNotNull() & F.col("target_thread").isNull())
    filled = (
        linked.where(is_open).join(done, "turn", "left")
        .join(late_target, "target", "left")
        .withColumns({"thread": F.coalesce("thread", "late_thread"), "target_thread": F.coalesce("target_thread", "target_late")})
        .select(*linked.columns)
    )
    return linked.where(~is_open).unionByName(filled)


def _follow(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Threads passed on along ``next`` in ``rows`` (turn, thread, next, root_thread), twice as far each round.

    Returns the rows that have a thread in the end, and those that have none. Only open rows are carried from round to round.
    """
    is_open = F.coalesce(F.col("thread").isNull() & F.col("next").isNotNull(), F.lit(False))
    settled, ended, now = rows.where("thread is not null"), rows.where("thread is null and next is null"), rows
    size, reach = now.where(is_open).count(), 1
    while size and reach <= 2 * size:
        here = now.where(is_open)
        ahead = settled.select(F.col("turn").alias("next"), F.col("thread").alias("_t"), F.lit(None).cast("long").alias("_n"))
        ahead = ahead.unionByName(ended.unionByName(here).select(F.col("turn").alias("next"), F.lit(None).cast("string").alias("_t"), F.col("next").alias("_n")))
        new = stage(here.join(ahead, "next", "left").select("turn", F.col("_t").alias("thread"), F.when(F.col("_t").isNull(), F.col("_n")).alias("next"), "root_thread"))
        settled, ended = settled.unionByName(new.where("thread is not null")), ended.unionByName(new.where("thread is null and next is null"))
        now, reach = new, reach * 2
        if not now.where(is_open).limit(1).count():
            return settled, ended
    # What still points on goes round in a circle.
    return settled, ended.unionByName(now.where(is_open)) if size else ended


def endless(turns: DataFrame) -> DataFrame:
    """Turns (scope_id, thread, turn) whose replies never end. Takes rows of ``assign_threads``.

    Conversations that need following are picked by a hash of their name; should two share it, one more is followed.
    """
    inside = turns.where("thread is not null and target is not null and thread = target_thread")
    onward = F.struct("target_at", "target") >= F.struct("at", "turn")
    hashed = inside.select(F.xxhash64("scope_id", "thread").alias("c"), "scope_id", "thread", "turn", F.col("target").alias("next"), onward.alias("onward"))
    suspects = hashed.where("onward").groupBy("c").agg(F.lit(1).alias("_")).select("c")
    rows = stage(hashed.drop("onward").join(suspects.hint("shuffle_hash"), "c", "left_semi"))
    longest = rows.groupBy("c").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach <= longest and rows.limit(1).count():
        ahead = rows.select(F.col("turn").alias("next"), F.col("next").alias("_n"))
        # Replies whose chain has ended are gone; a row left after as many steps as there are replies is in, or leads to, a circle.
        new = stage(rows.join(ahead, "next").select("c", "scope_id", "thread", "turn", F.col("_n").alias("next")))
        drop(rows)
        rows, reach = new, reach * 2
    return rows.select("scope_id", "thread", "turn")


def verdicts(turns: DataFrame) -> DataFrame:
    """One row for each conversation: turns, shown turns, dangling replies, whether it is endless, and ``dropped``."""
    # Roles are an open set, so they are not gathered: two differ exactly if the least and the greatest do. By their hashes, so
    # that Spark aggregates by hash; two roles with the same one of 2^64 would be taken for one.
    spoke = F.when(F.col("shows") & (F.col("role") != "system"), F.xxhash64("role"))
    whole = turns.where("thread is not null").groupBy("scope_id", "thread").agg(
        F.count("*").alias("turns"),
        F.count_if("shows").alias("shown"),
        F.min(spoke).alias("role_a"),
        F.max(spoke).alias("role_b"),
        F.count_if(F.col("reply").isNotNull() & ~F.coalesce(F.col("target_thread") == F.col("thread"), F.lit(False))).alias("dangling"),
    )
    circles = endless(turns).groupBy("scope_id", "thread").agg(F.lit(True).alias("endless"))
    few = F.coalesce(F.col("role_a") == F.col("role_b"), F.lit(True))
    return (
        whole.join(circles.hint("shuffle_hash"), ["scope_id", "thread"], "left")
        .withColumn("endless", F.coalesce("endless", F.lit(False)))
        .withColumn("dropped", (F.col("dangling") > 0) | F.col("endless") | few)
        .drop("role_a", "role_b")
    )


def rebuild(messages: DataFrame) -> DataFrame:
    """Ordered turns of all sound conversations: scope_key, thread_id, position, role, at, text, turn, reply_turn.

    Turns that show nothing are left out of the text but not of the checks. Order is by (at, turn), a null time first; a
    conversation is numbered in pieces, so one with very many turns is no single task. Texts join the turns at the end, by the
    unique delivery they were said in.
    Defined results: messages that belong to no thread are in no conversation; an empty table gives none; extra columns
    are ignored.
    """
    turns = stage(assign_threads(fold_turns(messages)))
    sound = verdicts(turns).where("not dropped").select("scope_id", "thread")
    kept = turns.where("shows").join(sound, ["scope_id", "thread"], "left_semi").select("scope_id", "thread", "at", "turn", "role", "target", "said")
    placed = positions(kept, ["scope_id", "thread"], ["at", "turn"], "position")
    texts = messages.select(F.col("delivery_id").alias("said"), shown_text().alias("text"))
    return placed.join(texts, "said").join(_scopes(messages), "scope_id").select(
        "scope_key",
        F.col("thread").alias("thread_id"),
        "position",
        "role",
        "at",
        "text",
        "turn",
        F.col("target").alias("reply_turn"),
    )


def dropped(messages: DataFrame) -> DataFrame:
    """(scope_key, thread_id) of the conversations that ``rebuild`` drops."""
    turns = assign_threads(fold_turns(messages, with_text=False))
    return verdicts(turns).where("dropped").join(_scopes(messages), "scope_id").select("scope_key", F.col("thread").alias("thread_id"))


def _scopes(messages: DataFrame) -> DataFrame:
    """The scopes that ids stand for; null is one of them."""
    return messages.groupBy("scope_key").agg(F.lit(1).alias("_")).select(scope_id("scope_key").alias("scope_id"), "scope_key")
