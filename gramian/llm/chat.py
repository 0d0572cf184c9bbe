"""Tool-call linking: calls and results joined by identifier, ordered, validated, and written as canonical JSON.

Native: DataFrame functions only.

Messages are rows (conv_id, seq, kind, call_id, name, arguments, content), kind being ``call``, ``result`` or
``message``.  A call needs the calls of its conversation whose ids stand in its argument ``after`` (a string or an array of
them).  In a conversation messages stand by ``seq``, but a call that needs a later one comes after it.

Defined results: an id belongs to its conversation.  Of calls, or results, that repeat an id there the one with the
smallest (seq, content) is linked, the others are kept as messages, equal rows too.  A result without a call is an
``orphan``; a call without a result has a null content.
Arguments that aren't a JSON object, lack a required field, or have one of another type or not in the schema
are not valid; neither is a call of an unknown tool, without an id, or on a circle of needs or behind one; such calls
stand by ``seq``.  Arguments that don't parse are written as the string they are.
Needs that name no call are passed over.  Null text is null in the JSON.  A null conv_id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramian.operators.windows import numbered
from gramian.runtime import cut, written

#: The names of JSON types in a schema, and how the type of a parsed value begins.
TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY"}


def quoted(col: Column) -> Column:
    """A string as JSON, null as null."""
    whole = F.to_json(F.struct(col.alias("x")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def first_of_id(rows: DataFrame) -> DataFrame:
    """The first row of each call_id of a conversation, under ``key``, and the number ``n`` of rows; partial minima, so
    a frequent id isn't gathered."""
    least = F.min(F.struct("seq", "content", "conv_id", "call_id", "name", "arguments")).alias("r")
    return rows.where("call_id is not null").groupBy("key").agg(least, F.count(F.lit(1)).alias("n")).select("key", "n", "r.*")


def repeats(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The rows with an id that ``first_of_id`` passed over, equal rows as often as they stand there."""
    several = first.where("n > 1")
    whole = F.struct("seq", "content", "conv_id", "call_id", "name", "arguments").alias("row")
    counted = rows.join(several.select("key"), "key", "left_semi").groupBy(whole).agg(F.count(F.lit(1)).alias("times"))
    left = F.col("times") - F.coalesce("used", F.lit(0))
    rest = counted.join(several.select(whole, F.lit(1).alias("used")), "row", "left")
    return rest.select("row.*", F.explode(F.array_repeat(F.lit(0), left.cast("int")))).drop("col")


def valid(arguments: Column, name: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Whether parsed ``arguments`` fit their tool's schema: {tool: {field: (type, required)}}."""
    fits = F.lit(False)
    for tool, fields in schemas.items():
        ok = F.lit(True)
        for field, (kind, required) in fields.items():
            value = F.try_variant_get(arguments, f"$['{field}']", "variant")
            of_kind = F.coalesce(F.schema_of_variant(value).rlike(TYPES[kind]), F.lit(False))
            ok = ok & (of_kind if required else value.isNull() | of_kind)
        known = F.array(*[F.lit(f) for f in fields]).cast("array<string>")
        names = F.json_object_keys(F.to_json(arguments))
        ok = ok & (F.size(F.array_except(names, known)) == 0)
        fits = fits | ((name == tool) & ok)
    is_object = F.schema_of_variant(arguments).rlike("^OBJECT")
    return F.coalesce(is_object & fits, F.lit(False))


def placed(calls: DataFrame) -> DataFrame:
    """(key, at, sub, circular): by (at, sub, seq) every call comes after those it needs.

    ``at`` is the greatest seq of the call and all it needs, near or far, and ``sub`` the longest way to that one.  A conversation where all
    needs come earlier has the seq itself.  In others every call with needs follows one of them, at first the one of the greatest seq; along
    these ways (at, sub) is found by doubling them.  Where another need promises more, the call follows that one from then on, and so on until none does: then
    the values hold for all needs.  Calls that don't come to an end are on a circle, or behind one.  A step holds one row for each call and need, and never
    pairs of calls at a distance; doubling takes rounds by the logarithm of the longest way.
    """
    needs = calls.select("key", "conv_id", "seq", F.explode("needs").alias("need")).distinct().withColumn("need", _key("conv_id", "need"))
    edges = needs.join(calls.select(F.col("key").alias("need"), F.col("seq").alias("need_seq")), "need")
    edges = written(edges.select("key", F.struct("conv_id").alias("home"), "need", "need_seq", F.coalesce(F.col("need_seq") >= F.col("seq"), F.lit(True)).alias("late")))
    late = written(edges.where("late").select("home").distinct())
    if late.isEmpty():
        return calls.select("key", F.col("seq").alias("at"), F.lit(0).cast("long").alias("sub"), F.lit(False).alias("circular"))
    edges = written(edges.join(late, "home", "left_semi").select("key", "need", "need_seq"))
    nodes = written(calls.select("key", "seq", F.struct("conv_id").alias("home")).join(late, "home", "left_semi"))
    most = nodes.groupBy("home").count().agg(F.max("count")).first()[0]
    choice = edges.join(edges.groupBy("key").count().where("count > 1").select("key"), "key", "left_semi")
    choice, chosen = written(choice.select("key", "need")), written(edges.groupBy("key").agg(F.max(F.struct("need_seq", "need"))["need"].alias("to")))
    while True:
        values = _along(nodes, chosen, most)
        ahead = values.select(F.col("key").alias("need"), F.col("to").isNotNull().alias("circular"), F.struct("best.at", (F.col("best.sub") + 1).alias("sub")).alias("further"))
        offers = choice.join(ahead, "need").groupBy("key").agg(F.max(F.struct("circular", "further", "need")).alias("offer"))
        better = written(offers.join(values.where("to is null"), "key").where("offer.circular or offer.further > best").select("key", F.col("offer.need").alias("other")))
        if better.isEmpty():
            break
        chosen = written(chosen.join(better, "key", "left").select("key", F.coalesce("other", "to").alias("to")))
    found = values.select("key", F.col("to").isNotNull().alias("circular"), "best")
    own = calls.select("key", "seq").join(found, "key", "left").withColumn("ends", F.coalesce(~F.col("circular"), F.lit(False)))
    at, sub = F.when(F.col("ends"), F.col("best.at")).otherwise(F.col("seq")), F.when(F.col("ends"), F.col("best.sub")).otherwise(F.lit(0).cast("long"))
    return own.select("key", at.alias("at"), sub.alias("sub"), F.coalesce("circular", F.lit(False)).alias("circular"))


def _along(nodes: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """(key, to, best): the greatest (at, sub) on the way from each node (key, seq) along ``chosen`` (key, to).  ``to`` is null where the way
    ends; a way of ``most`` steps doesn't."""
    now, steps = written(nodes.join(chosen, "key", "left").select("key", "to", F.struct(F.col("seq").alias("at"), F.lit(0).cast("long").alias("sub")).alias("best"))), 1
    while steps < most and not now.where("to is not null").isEmpty():
        # A node whose way has ended meets itself, so no rows meet at null and no union adds partitions.
        on = now.select(F.col("key").alias("on"), F.col("to").alias("next"), F.struct("best.at", (F.col("best.sub") + steps).alias("sub")).alias("further"))
        moved = now.join(on, F.coalesce("to", "key") == F.col("on"))
        best = F.when(F.col("to").isNull(), F.col("best")).otherwise(F.greatest("best", "further"))
        now, steps = written(moved.select("key", F.when(F.col("to").isNotNull(), F.col("next")).alias("to"), best.alias("best"))), 2 * steps
    return now


def needs_of(arguments: Column) -> Column:
    """The ids in the argument ``after``, a string or an array of them."""
    after = F.try_variant_get(F.try_parse_json(arguments), "$.after", "variant")
    needs = F.coalesce(F.try_variant_get(after, "$", "array<string>"), F.array(F.try_variant_get(after, "$", "string")))
    return F.filter(F.coalesce(needs, F.array().cast("array<string>")), lambda x: x.isNotNull())


def _key(conv_id: str, call_id: str) -> Column:
    """An id within its conversation; a null conversation equals itself, as a field of a struct."""
    return F.struct(F.col(conv_id).alias("conv_id"), F.col(call_id).alias("call_id"))


def linked(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """(conv_id, place, sub, seq, kind, call_id, answered, valid, json): every message once, a linked result inside its call; in a
    conversation they stand by (place, sub, seq, kind, json).  JSON is canonical: no spaces, keys in order.  No conversation
    is gathered anywhere."""
    messages = messages.select(F.col("conv_id").cast("long"), F.col("seq").cast("long"), "kind", F.col("call_id").cast("string"), F.col("name").cast("string"), F.col("arguments").cast("string"), F.col("content").cast("string")).withColumn("key", _key("conv_id", "call_id"))
    first_calls = cut(first_of_id(messages.where("kind = 'call'")))
    results = messages.where("kind = 'result'")
    first_results = cut(first_of_id(results))
    calls = first_calls.select("key", "conv_id", "call_id", "seq", "name", _canonical().alias("canonical"), valid(F.try_parse_json("arguments"), F.col("name"), schemas).alias("fits"), needs_of(F.col("arguments")).alias("needs"))
    whole = calls.join(first_results.select("key", "content", F.lit(True).alias("answered")), "key", "left").join(placed(calls), "key", "left")
    whole = whole.withColumn("valid", F.col("fits") & ~F.col("circular"))
    whole = whole.select("conv_id", F.col("at").alias("place"), "sub", "seq", F.lit("call").alias("kind"), "call_id", F.coalesce("answered", F.lit(False)).alias("answered"), "valid", _call_json().alias("json"))

    again = repeats(messages.where("kind = 'call'"), first_calls).unionByName(messages.where("kind = 'call' and call_id is null").drop("key", "kind"))
    again = again.unionByName(repeats(results, first_results.join(first_calls.select("key"), "key", "left_semi")))
    orphans = results.join(first_calls.select("key"), "key", "left_anti")
    plain = lambda df, kind: df.select("conv_id", F.col("seq").alias("place"), F.lit(0).cast("long").alias("sub"), "seq", F.lit(kind).alias("kind"), "call_id", F.lit(False).alias("answered"), F.lit(False).alias("valid"), _plain_json().alias("json"))
    return whole.unionByName(plain(messages.where("kind not in ('call', 'result') or kind is null"), "message")).unionByName(plain(orphans, "orphan")).unionByName(plain(again, "message"))


def conversations(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """(conv_id, n_calls, n_linked, n_valid, n_orphans, messages): ``linked`` with a row for each conversation and its messages
    as one JSON array.  For conversations that fit in a row; ``linked`` has no such bound."""
    count = lambda c: F.count_if(c).alias
    ordered = F.array_sort(F.collect_list(F.struct("place", "sub", "seq", "kind", "json")))
    return linked(messages, schemas).groupBy("conv_id").agg(count(F.col("kind") == "call")("n_calls"), count(F.col("answered"))("n_linked"), count(F.col("valid"))("n_valid"), count(F.col("kind") == "orphan")("n_orphans"), F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["json"]), ","), F.lit("]")).alias("messages"))


def _canonical() -> Column:
    """The arguments as canonical JSON; what doesn't parse is a JSON string, null stays null."""
    return F.coalesce(F.to_json(F.try_parse_json("arguments")), F.when(F.col("arguments").isNotNull(), quoted(F.col("arguments"))))


def _call_json() -> Column:
    return F.concat(F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(',"content":'), quoted(F.col("content")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"valid":'), F.col("valid").cast("string"), F.lit("}"))


def _plain_json() -> Column:
    """A message that isn't a linked call: its arguments and its id stand there if it has any."""
    arguments = F.coalesce(F.concat(F.lit('"arguments":'), _canonical(), F.lit(",")), F.lit(""))
    ident = F.when(F.col("call_id").isNotNull(), F.concat(F.lit(',"id":'), quoted(F.col("call_id")))).otherwise(F.lit(""))
    return F.concat(F.lit("{"), arguments, F.lit('"content":'), quoted(F.col("content")), ident, F.lit(',"role":'), quoted(F.coalesce("name", F.lit("unknown"))), F.lit("}"))


def _neighbours(turns: DataFrame) -> DataFrame:
    """(at, earlier, later, rank): for each of the distinct (conv_id, turn), as ``at``, the turns before and after it in its conversation, and its rank there if that
    is 1 or 2, else 3.  Turns are numbered over ranges and sent to the numbers nearby, so a long conversation isn't one task's."""
    sent = numbered(turns, F.col("conv_id"), F.col("turn")).select("conv_id", "turn", "number", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1, 2)])).alias("k"))
    row = F.struct("conv_id", "turn")
    by_k = {name: F.max(F.when(F.col("k") == k, row)).alias(name) for name, k in (("next", -1), ("at", 0), ("last", 1), ("last2", 2))}
    met = sent.groupBy((F.col("number") + F.col("k")).alias("number")).agg(*by_k.values()).where("at is not null")
    same = lambda name: F.when(F.col(f"{name}.conv_id").eqNullSafe(F.col("at.conv_id")), F.col(f"{name}.turn"))
    rank = F.when(same("last").isNull(), 1).when(same("last2").isNull(), 2).otherwise(3)
    return met.select("at", same("last").alias("earlier"), same("next").alias("later"), rank.alias("rank"))


def from_turns(turns: DataFrame) -> DataFrame:
    """Messages from (conv_id, turn, role, text), by rule.  A user's turn is a call, ``call_`` and its turn being the id, and an assistant's turn
    the result of the turn before it; any other is a plain message.  A call needs the user's turn before.  In every third
    conversation the first user's turn needs the second instead, which has no need; but in every ninth it keeps its own, which makes a circle.
    Every seventh character count of a user's text gives ``limit`` as a string, which the schema refuses; every eleventh a
    second call with the same id; every fifth of an assistant's text a second result."""
    call = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    near = _neighbours(turns.where(user & F.col("turn").isNotNull()).select("conv_id", "turn").distinct())
    at = F.struct("conv_id", F.when(user, F.col("turn")).alias("turn"))
    turns = turns.withColumn("at", at).join(near, "at", "left").drop("at")
    third, ninth = (F.coalesce(F.col("conv_id") % k == 0, F.lit(False)) for k in (3, 9))
    need = F.when(third & (F.col("rank") == 1), F.col("later")).when(third & ~ninth & (F.col("rank") == 2), F.lit(None)).otherwise(F.col("earlier"))
    tool = F.when(F.col("turn") % 4 == 0, F.lit("search")).otherwise(F.lit("lookup"))
    limit = F.length("text") % 10
    odd = F.length("text") % 7 == 0
    arguments = lambda limit: F.to_json(F.struct(F.col("text").alias("query"), limit.alias("limit"), call(need).alias("after")))
    first = turns.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(user, call(F.col("turn"))).when(assistant, call(F.col("turn") - 1)).alias("call_id"),
        F.when(user, tool).otherwise(F.col("role")).alias("name"),
        F.when(user & odd, arguments(limit.cast("string"))).when(user, arguments(limit)).alias("arguments"),
        F.when(~user | F.col("role").isNull(), F.col("text")).alias("content"),
        F.coalesce((user & (F.length("text") % 11 == 0)) | (assistant & (F.length("text") % 5 == 0)), F.lit(False)).alias("twice"),
    )
    # One pass: a row that comes twice is exploded into itself and its repeat.
    both = first.withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    repeated = F.col("copy") == 1
    content = F.when(repeated & (F.col("kind") == "result"), F.concat("content", F.lit(" (again)"))).otherwise(F.col("content"))
    name = F.when(repeated & (F.col("kind") == "call"), F.lit("zz_again")).otherwise(F.col("name"))
    return both.select("conv_id", "seq", "kind", "call_id", name.alias("name"), F.when(~repeated, F.col("arguments")).alias("arguments"), content.alias("content"))


#: The tools of ``from_turns``.
SCHEMAS = {tool: {"query": ("string", True), "limit": ("integer", True), "after": ("string", False)} for tool in ("search", "lookup")}
