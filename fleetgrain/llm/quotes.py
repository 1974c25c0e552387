"""Quotation linking: messages that quote others are linked to them and put in reply order, without the quotes.

A line's quote level is the number of `>` that lead it. Neighbouring lines of one level are a passage. Passages and single lines are normalised
(lines joined by a space, white space collapsed, lower case) and hashed. A quoted passage is linked as a whole if its hash is that of an
original (level 0) passage or line, else by the first of its lines that is an original line or passage, so quotes of a part are linked too. The original is
the latest earlier turn of the same conversation that has it, else the first message anywhere, by (conv_id, turn), if that comes before
the quoting one. Every link so leads to an earlier message and replies never form a circle.

A message replies to what its first linked passage was taken from; without one, to the turn numbered one less in its conversation, if
that exists. Its thread is the message that its replies lead back to and its depth the number of replies in between; ordered by
(thread_conv, thread_turn, reply_depth, conv_id, turn), every message follows the one that it replies to.

Everything is built of DataFrame functions. Quoted hashes are found first; of the originals only those are kept. What is shuffled are
hashes and message numbers, and the messages once. A common line is joined by broadcast (common.by_key), and orders within a conversation are
taken in two steps, over blocks of BLOCK turns and inside them, so that neither a line nor a conversation with a large share of
all rows is one task. Runs of messages that reply to the turn before are folded before threads are followed, by pointer doubling over the rest.

Nulls: a null text has no lines and stays null; null conv_id and turn match themselves and come last. Rows of one (conv_id, turn) are one message for
linking, and each is returned. Empty passages are no quotes. Empty tables give empty results. Extra columns are kept, whatever
their names; input columns named as those of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 1024
_MARK = r"^(?:[ \t]*>)+"
_RESULT = ("reply_to_conv", "reply_to_turn", "n_quotes", "n_linked", "thread_conv", "thread_turn", "reply_depth")


def passages(text: str) -> Column:
    """Array of (level, body, lines) of the passages of a text, normalised, empty ones and empty lines left out."""
    plain = "lower(trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ')))"
    cut = f"regexp_replace(l, '{_MARK}', '')"
    return F.expr(f"""
        transform(
          transform(
            transform(array(split({text}, '\\n')), lines -> struct(lines, transform(lines, l -> length(regexp_replace(regexp_extract(l, '{_MARK}', 0), '[^>]', ''))) as levels)),
            p -> struct(p.lines, p.levels, filter(sequence(0, size(p.lines) - 1), i -> i = 0 or p.levels[i] <> p.levels[i - 1]) as heads)),
          p -> filter(transform(
              transform(p.heads, (head, k) -> struct(
                p.levels[head] as level,
                slice(p.lines, head + 1, if(k + 1 < size(p.heads), p.heads[k + 1], size(p.lines)) - head) as lines)),
              r -> struct(
                r.level,
                {plain.format(f"array_join(transform(r.lines, l -> {cut}), ' ')")} as body,
                filter(transform(r.lines, l -> {plain.format(cut)}), l -> l <> '') as lines)),
            x -> x.body <> ''))[0]""".replace("\\", "\\\\"))


def without_quotes(text: str) -> Column:
    """The text without its quoted lines, trimmed; a text without any is as it was."""
    mark = _MARK.replace("\\t", "\\\\t")
    lines = f"split({text}, '\\\\n')"
    return F.expr(f"if(exists({lines}, l -> l rlike '{mark}'), trim(array_join(filter({lines}, l -> not l rlike '{mark}'), '\\n')), {text})")


def _units(messages: DataFrame, quoted: bool) -> DataFrame:
    """conv_id, turn, place (of the passage), line (-1: the passage as a whole) and hash of quoted or original text."""
    rows = messages.select("conv_id", "turn", F.posexplode(passages("text")).alias("place", "p"))
    rows = rows.where(F.col("p.level") > 0 if quoted else F.col("p.level") == 0)
    units = F.expr("concat(array(struct(-1 as line, p.body as body)), if(size(p.lines) > 1, transform(p.lines, (l, i) -> struct(i as line, l as body)), array()))")
    rows = rows.select("conv_id", "turn", "place", F.explode(units).alias("u"))
    return rows.select("conv_id", "turn", "place", "u.line", F.md5(F.col("u.body").cast("binary")).alias("hash")).distinct()


def _place(conv_id: str = "conv_id", turn: str = "turn") -> Column:
    """A message's place in the order of all, nulls last."""
    return F.struct(F.col(conv_id).isNull().alias("no_conv"), F.col(conv_id).alias("conv_id"), F.col(turn).isNull().alias("no_turn"), F.col(turn).alias("turn"))


def _id(conv_id: Column, turn: Column) -> Column:
    """A message's number in the result of a cast, as one text."""
    return F.concat(F.coalesce(conv_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(turn.cast("string"), F.lit("")))


def _running_max(rows: DataFrame, keys: list[str], value: str, own: bool) -> DataFrame:
    """rows with so_far: the greatest value of the rows of keys with a lesser turn (own: or this one), in two steps by blocks of turns."""
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    rows = rows.withColumn("block", block)
    tops = rows.groupBy(*keys, "block").agg(F.max(value).alias("top"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn(value, F.max("top").over(before)).where(F.col(value).isNotNull()).select(*keys, "block", value, (F.col("block") * BLOCK - 1).alias("turn"), F.lit(True).alias("carried"))
    inside = Window.partitionBy(*keys, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0 if own else -1)
    both = rows.withColumn("carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    return both.withColumn("so_far", F.max(value).over(inside)).where("not carried").drop("carried", "block")


def _targets(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_quotes, n_linked and to (conv_id, turn), the message of the first linked passage, of every quoting message."""
    quotes = common.stored(_units(messages, True), "quotes")
    asked = common.stored(quotes.select("hash").distinct(), "quote-hashes")
    originals = common.matched(_units(messages, False), asked, "hash", "left_semi")
    originals = common.stored(originals.select("conv_id", "turn", "hash").distinct(), "quote-originals")
    both = originals.withColumn("origin", F.col("turn")).unionByName(quotes, allowMissingColumns=True)
    near = _running_max(both, ["conv_id", "hash"], "origin", own=False).where("place is not null")
    # anywhere: the first message with it
    first = both.groupBy("hash").agg(F.min(F.when(F.col("place").isNull(), _place())).alias("first"), F.count("*").alias("n"))
    found = common.by_key(near, common.stored(first, "quote-first"), "hash", both.count())
    here = F.struct("conv_id", F.col("so_far").alias("turn"))
    there = F.when(F.col("first") < _place(), F.struct(F.col("first.conv_id").alias("conv_id"), F.col("first.turn").alias("turn")))
    found = found.withColumn("to", F.when(F.col("so_far").isNotNull(), here).otherwise(there))
    # of a passage: the whole before its lines; of a message: the first passage that is linked
    linked = F.col("to").isNotNull()
    each = found.groupBy("conv_id", "turn", "place").agg(F.min_by("to", F.when(linked, F.col("line"))).alias("to"))
    return each.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("to").alias("n_linked"), F.min_by("to", F.when(linked, F.col("place"))).alias("to"))


def _threads(nodes: DataFrame) -> DataFrame:
    """id, thread (the message that replies lead back to) and depth of nodes (id, conv_id, turn, to, follows)."""
    # messages that reply to the turn before go back to the head of their run, the last turn that doesn't
    run = _running_max(nodes.withColumn("head_turn", F.when(~F.col("follows"), F.col("turn"))), ["conv_id"], "head_turn", own=True)
    head_turn = F.when(F.col("follows"), F.col("so_far")).otherwise(F.col("turn"))
    run = run.select("id", "conv_id", "turn", "to", "follows", _id(F.col("conv_id"), head_turn).alias("head"), F.coalesce(F.col("turn") - head_turn, F.lit(0)).alias("steps"))
    run = common.stored(run, "quote-runs")
    # heads that quote: the head of what they reply to
    quoting = run.where("not follows and to is not null").select("id", _id(F.col("to.conv_id"), F.col("to.turn")).alias("up"))
    ups = quoting.groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n"))
    ups = common.stored(ups.join(run.select("id", "head", "steps"), "id").select(F.col("id").alias("up"), "n", F.col("head").alias("above"), "steps"), "quote-ups")
    total = quoting.count()
    heads = common.by_key(quoting, ups, "up", total).select("id", "above", (F.col("steps") + 1).alias("depth"), F.lit(False).alias("done"))
    heads = common.stored(heads, "quote-heads")
    while not heads.where("not done").isEmpty():
        # what is above a head that quotes nothing is done: such heads have no row
        asked = heads.where("not done").groupBy(F.col("above").alias("id")).agg(F.count("*").alias("n"))
        next_ = asked.join(heads.select("id", F.col("above").alias("then"), F.col("depth").alias("more"), F.col("done").alias("then_done")), "id", "left").withColumnRenamed("id", "above")
        moved = common.by_key(heads.where("not done"), common.stored(next_, "quote-above"), "above", total)
        end = F.col("then").isNull()
        moved = moved.select("id", F.coalesce("then", "above").alias("above"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (end | F.col("then_done")).alias("done"))
        heads = common.stored(moved.unionByName(heads.where("done")), "quote-heads")
    ends = run.groupBy("head").agg(F.count("*").alias("n")).join(heads.select(F.col("id").alias("head"), "above", "depth"), "head", "left")
    ends = common.by_key(run.select("id", "head", "steps"), common.stored(ends, "quote-ends"), "head", run.count())
    return ends.select("id", F.coalesce("above", "head").alias("thread"), (F.col("steps") + F.coalesce("depth", F.lit(0))).cast("long").alias("depth"))


def linked(conversations: DataFrame) -> DataFrame:
    """conversations (all columns, text without quotes) with reply_to_conv, reply_to_turn, n_quotes, n_linked, thread_conv, thread_turn and reply_depth."""
    messages = conversations.drop(*_RESULT)  # of the result, not of the input
    narrow = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    of = common.stored(_targets(narrow), "quote-targets")
    # one group a message: itself, the note of the turn before, and what it quotes
    own = narrow.select("conv_id", "turn", F.lit(True).alias("own"))
    noted = narrow.where("turn is not null").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("before"))
    nodes = own.unionByName(noted, allowMissingColumns=True).unionByName(of, allowMissingColumns=True)
    nodes = nodes.groupBy("conv_id", "turn").agg(*[F.max(c).alias(c) for c in ("own", "before", "n_quotes", "n_linked", "to")]).where("own")
    previous = F.when(F.col("before"), F.struct("conv_id", (F.col("turn") - 1).alias("turn")))
    to = F.coalesce("to", previous)
    nodes = nodes.select(_id(F.col("conv_id"), F.col("turn")).alias("id"), "conv_id", "turn", "n_quotes", "n_linked", to.alias("to"), F.coalesce(previous == to, F.lit(False)).alias("follows"))
    nodes = common.stored(nodes, "quote-nodes")
    threads = _threads(nodes.drop("n_quotes", "n_linked"))
    part = lambda c, i, kind: F.when(F.split(c, "\n")[i] != "", F.split(c, "\n")[i]).cast(kind)
    kind = dict(narrow.dtypes)["conv_id"]
    found = nodes.join(threads, "id").select(
        F.col("id").alias("key"),
        F.struct(
            F.col("to.conv_id").alias("reply_to_conv"),
            F.col("to.turn").alias("reply_to_turn"),
            F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
            part("thread", 0, kind).alias("thread_conv"),
            part("thread", 1, "long").alias("thread_turn"),
            F.col("depth").alias("reply_depth"),
        ).alias("found"),
    )
    key, result = common.free_name(messages, "key"), common.free_name(messages, "found")
    out = messages.withColumn(key, _id(F.col("conv_id"), F.col("turn").cast("long"))).join(found.toDF(key, result), key)
    kept = [without_quotes("text").alias("text") if c == "text" else F.col(f"`{c}`") for c in messages.columns]
    return out.select(*kept, *[F.col(result)[c].alias(c) for c in _RESULT])


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


OP3_SQL = r"""
with recursive l as (select conv_id, turn, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as i from (select distinct conv_id, turn, text from conversations)),
v as (select *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) as level, regexp_replace(line, '^(?:[ \t]*>)+', '') as body from l),
h as (select *, case when lag(level) over w is distinct from level then 1 else 0 end as head from v window w as (partition by conv_id, turn order by i)),
g as (select *, sum(head) over (partition by conv_id, turn order by i) as run, lower(trim(regexp_replace(body, '[ \t\r\n]+', ' ', 'g'))) as one from h),
p as (select conv_id, turn, run, -1 as line, any_value(level) as level, lower(trim(regexp_replace(string_agg(body, ' ' order by i), '[ \t\r\n]+', ' ', 'g'))) as body from g group by conv_id, turn, run
  union all select conv_id, turn, run, i, level, one from g),
c as (select conv_id, turn, run, line, level, md5(body) as hash from p where body <> ''),
o as (select distinct conv_id, turn, hash from c where level = 0),
f as (select hash, min({'c': conv_id, 't': turn}) as first from o group by hash),
q as (select c.conv_id, c.turn, c.run, c.line, (select max(o.turn) from o where o.conv_id = c.conv_id and o.hash = c.hash and o.turn < c.turn) as near, f.first from c left join f on c.hash = f.hash where level > 0),
t as (select *, case when near is not null then {'c': conv_id, 't': near} when first < {'c': conv_id, 't': turn} then first end as target from q),
s as (select conv_id, turn, run, arg_min(target, line) filter (where target is not null) as target from t group by conv_id, turn, run),
a as (select conv_id, turn, count(*) as n_quotes, count(target) as n_linked, arg_min(target, run) filter (where target is not null) as target from s group by conv_id, turn),
n as (select m.conv_id, m.turn, coalesce(a.target, case when b.turn is not null then {'c': m.conv_id, 't': m.turn - 1} end) as target, coalesce(a.n_quotes, 0)::bigint as n_quotes, coalesce(a.n_linked, 0)::bigint as n_linked
  from (select distinct conv_id, turn from conversations) m left join a on a.conv_id = m.conv_id and a.turn = m.turn
  left join (select distinct conv_id, turn from conversations) b on b.conv_id = m.conv_id and b.turn = m.turn - 1),
r as (select conv_id, turn, conv_id as thread_conv, turn as thread_turn, 0::bigint as depth from n where target is null
  union all select n.conv_id, n.turn, r.thread_conv, r.thread_turn, r.depth + 1 from n join r on n.target.c = r.conv_id and n.target.t = r.turn)
select m.conv_id, m.turn, m.role,
  case when len(list_filter(string_split(m.text, chr(10)), lambda x: regexp_matches(x, '^(?:[ \t]*>)+'))) > 0
    then trim(array_to_string(list_filter(string_split(m.text, chr(10)), lambda x: not regexp_matches(x, '^(?:[ \t]*>)+')), chr(10))) else m.text end as text,
  n.target.c as reply_to_conv, n.target.t::bigint as reply_to_turn, n.n_quotes, n.n_linked, r.thread_conv, r.thread_turn::bigint as thread_turn, r.depth as reply_depth
from conversations m join n on n.conv_id = m.conv_id and n.turn = m.turn join r on r.conv_id = m.conv_id and r.turn = m.turn
"""
