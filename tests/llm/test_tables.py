"""Code search, chat formatting and the pipeline on small tables."""

import json
import random

from pyspark.sql import functions as F

from gramian.llm import chat, hamming


def brute_nearest(rows, k):
    out = []
    for q, qc in sorted(set(rows)):
        if q % 20 == 0:
            best = {}
            for i, c in set(rows):
                if i != q:
                    best[i] = min(best.get(i, 99), (qc ^ c).bit_count())
            ranked = sorted((d, i) for i, d in best.items())[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(ranked)]
    return sorted(out)


def test_nearest(spark):
    rng = random.Random(1)
    hot = rng.getrandbits(63)
    rows = [(k, rng.getrandbits(63) if k % 3 else hot ^ (1 << rng.randrange(63) if k % 2 else 0)) for k in range(260)]
    df = spark.createDataFrame(rows + rows[:5], "id long, code long")
    got = sorted(tuple(r) for r in hamming.nearest(df, df.where("id % 20 = 0"), 4).collect())
    assert got == brute_nearest(rows, 4)


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, 5), (1, 7), (2, 5)], "id long, code long")
    assert sorted(tuple(r) for r in hamming.nearest(df, df.where("id = 0"), 10).collect()) == [(0, 1, 2, 0), (0, 2, 1, 1)]
    none = df.limit(0)
    assert hamming.nearest(none, none, 10).count() == 0


def test_sign_codes(spark):
    rows = [(1, [1.0, -1.0, 0.0, 2.0], "x"), (2, None, "x"), (None, [1.0], "x"), (3, [None, 1.0], "x"), (4, [1.0] * 64, "x"), (5, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string")
    assert {r.id: r.code for r in hamming.sign_codes(df).collect()} == {1: 9, 3: 2, 4: -1, 5: 0}


MESSAGES = "conv_id long, seq long, kind string, call_id string, name string, arguments string, content string, level int"


def test_conversations(spark):
    ok = '{"query":"x","limit":1%s}'
    rows = [
        (1, 0, "call", "a", "search", ok % ',"after":"b"', None, 0),
        (1, 1, "call", "b", "search", '{"limit": 2, "query": "y"}', None, 0),
        (1, 2, "result", "a", None, None, "first", 0),
        (1, 3, "result", "a", None, None, "second", 0),
        (1, 4, "result", "zz", None, None, "lost", 0),
        (1, 5, "call", "c", "search", ok % ',"after":["a","d"]', None, 0),
        (1, 6, "call", "d", "lookup", ok % ',"after":"c"', None, 0),
        (1, 7, "call", None, "search", "{}", None, 0),
        (1, 8, "call", "b", "search", ok % "", "again", 0),
        (2, 0, "message", None, "user", None, 'a "q"\n é', 0),
        (2, 1, None, None, None, None, None, None),
        (3, 0, "call", "t1", "search", '{"query":1,"limit":1}', None, 0),
        (3, 1, "call", "t2", "search", '{"query":"x","limit":1,"more":0}', None, 0),
        (3, 2, "call", "t3", "nothing", ok % "", None, 0),
        (3, 3, "call", "t4", "search", "[1]", None, 0),
        (3, 4, "call", "t5", "search", "{broken", None, 0),
        (3, 5, "call", "t6", "search", None, None, 0),
        (3, 6, "call", "t7", "search", ok % ',"after":"nobody"', None, 0),
        (None, 0, "call", "n", "search", ok % "", None, 0),
    ]
    got = {r.conv_id: r for r in chat.conversations(spark.createDataFrame(rows, MESSAGES), chat.SCHEMAS).collect()}
    assert {i: tuple(r)[1:5] for i, r in got.items()} == {1: (4, 1, 2, 1), 2: (0, 0, 0, 0), 3: (7, 0, 1, 0), None: (1, 0, 1, 0)}
    one = json.loads(got[1].messages)
    ids = [m["id"] for m in one if "valid" in m]
    assert ids.index("b") < ids.index("a") and {m["id"]: m["valid"] for m in one if "valid" in m} == {"a": True, "b": True, "c": False, "d": False}
    assert next(m for m in one if m.get("id") == "a")["content"] == "first"
    assert got[2].messages == '[{"content":"a \\"q\\"\\n é","role":"user"},{"content":null,"role":"unknown"}]'
    assert '"arguments":{"after":"nobody","limit":1,"query":"x"}' in got[3].messages and '"arguments":null' in got[3].messages
    assert chat.conversations(spark.createDataFrame([], MESSAGES), chat.SCHEMAS).count() == 0


def test_no_message_is_lost(spark):
    ok = '{"query":"x","limit":1}'
    rows = [
        (1, 0, "call", "a", "search", ok, None, 0),
        (1, 0, "call", "a", "search", ok, None, 0),
        (1, 0, "call", "a", "lookup", ok, None, 0),
        (1, 1, "result", "a", "tool", None, "first", 0),
        (1, 1, "result", "a", "tool", None, "first", 0),
        (1, 2, "result", "a", None, None, "second", 0),
        (2, 0, "call", "a", "search", '{"query":"x","limit":1,"after":"b"}', None, 0),
        (2, 1, "call", "b", "lookup", ok, None, 0),
        (2, 2, "result", "a", "tool", None, "of the other", 0),
        (3, 0, "result", "a", "tool", None, "without", 0),
        (3, 1, "result", None, "tool", None, "no id", 0),
        (None, 0, "call", "a", "search", ok, None, 0),
        (None, 1, "result", "a", "tool", None, "of none", 0),
        (None, 2, "result", "a", "tool", None, None, 0),
        (None, 2, "result", "a", "tool", None, None, 0),
    ]
    got = {r.conv_id: r for r in chat.conversations(spark.createDataFrame(rows, MESSAGES), chat.SCHEMAS).collect()}
    assert {i: tuple(r)[1:5] for i, r in got.items()} == {1: (1, 1, 1, 0), 2: (2, 1, 2, 0), 3: (0, 0, 0, 2), None: (1, 1, 1, 0)}
    shown = {i: [(m.get("id"), m.get("role"), m["content"]) for m in json.loads(r.messages)] for i, r in got.items()}
    assert sorted(shown[1], key=str) == sorted([("a", None, "first"), ("a", "search", None), ("a", "search", None), ("a", "tool", "first"), ("a", "unknown", "second")], key=str)
    assert shown[2] == [("b", None, None), ("a", None, "of the other")]
    assert shown[3] == [("a", "tool", "without"), (None, "tool", "no id")]
    assert shown[None] == [("a", None, "of none"), ("a", "tool", None), ("a", "tool", None)]


def test_long_chains_in_few_rounds(spark, monkeypatch):
    """2,000 calls, each of which needs the one before; in another conversation the one after, and in a third all but the last are on a circle."""
    cuts = []
    for name in ("cut", "written"):
        monkeypatch.setattr(chat, name, lambda df, own=getattr(chat, name): cuts.append(1) or own(df))
    call = lambda conv, k, need: (conv, k, "call", f"c{k}", "search", json.dumps({"query": "x", "limit": 1, "after": f"c{need}"}), None, 0)
    rows = [call(1, k, k - 1) for k in range(2000)] + [call(2, k, k + 1) for k in range(300)] + [call(3, k, (k + 1) % 9) for k in range(9)] + [call(3, 9, 77)]
    got = {r.conv_id: r for r in chat.conversations(spark.createDataFrame(rows, MESSAGES), chat.SCHEMAS).collect()}
    order = {i: [int(m["id"][1:]) for m in json.loads(r.messages)] for i, r in got.items()}
    assert got[1].n_valid == 2000 and order[1] == list(range(2000))
    assert got[2].n_valid == 300 and order[2] == list(range(299, -1, -1))
    assert got[3].n_valid == 1 and order[3] == list(range(10))
    assert len(cuts) < 40


def test_order_of_many_needs(spark, monkeypatch):
    """Calls with several needs, near and far, forwards and back, circles among them, against ways followed one by one; no step has more rows than calls and needs."""
    rng, rows, want = random.Random(5), [], {}
    shapes = [lambda i, n: [i + 1, i + 2], lambda i, n: [i - 1, i - 2], lambda i, n: [rng.randrange(n) for _ in range(rng.choice((0, 1, 2, 2)))], lambda i, n: [i + rng.randrange(1, 9) for _ in range(3)], lambda i, n: [i - 1, n - 1] if i < n - 1 else []]
    for conv, shape in enumerate([*shapes, shapes[2], shapes[3]]):
        n = 30
        seqs = list(range(n)) if conv < 5 else rng.sample(range(n), n)
        if conv == 6:
            seqs[7] = seqs[8] = None
        needs = [[j for j in shape(i, n) if 0 <= j < n] for i in range(n)]
        rows += [(conv or None, q, "call", f"c{i}", "search", json.dumps({"query": "x", "limit": 1, "after": [f"c{j}" for j in needs[i]]}), None, 0) for i, q in enumerate(seqs)]
        level = lambda q: -1 if q is None else q
        best = {i: (level(q), 0) for i, q in enumerate(seqs)}
        ends = set()
        for _ in range(n):
            best = {i: max([best[i], *((best[j][0], best[j][1] + 1) for j in needs[i])]) for i in best}
            ends |= {i for i in best if all(j in ends for j in needs[i])}
        want |= {(conv or None, f"c{i}"): (*best[i], False) if i in ends else (level(seqs[i]), 0, True) for i in best}
    sizes = []
    monkeypatch.setattr(chat, "written", lambda df, own=chat.written: sizes.append((out := own(df)).count()) or out)
    calls = spark.createDataFrame(rows, MESSAGES).select(chat._key("conv_id", "call_id").alias("key"), "conv_id", F.col("seq").cast("long").alias("seq"), chat.needs_of(F.col("arguments")).alias("needs"))
    got = {tuple(r.key): (-1 if r["at"] is None else r["at"], r["sub"], r.circular) for r in chat.placed(calls).collect()}
    assert got == want and any(v[2] for v in want.values()) and any(v[1] > 10 for v in want.values())
    assert max(sizes) <= 3 * len(rows) and len(sizes) < 150


def test_turns_of_one_conversation_are_not_gathered(spark):
    """Neighbours among the users' turns against a plain loop, null conversations and repeated turns too; the plan has no window."""
    rng = random.Random(6)
    turns = [(c, t, rng.choice(["user", "user", "assistant", None]), "x" * rng.randrange(1, 30)) for c in [3, 6, 9, 10, None] for t in [*rng.sample(range(60), 40), 5, None]]
    messages = chat.from_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert "Window" not in messages._jdf.queryExecution().toString()
    users = {c: sorted({t for k, t, r, _ in turns if k == c and r == "user" and t is not None}) for c in [3, 6, 9, 10, None]}
    seen = 0
    for r in messages.where("kind = 'call' and call_id is not null and arguments is not null").collect():
        own = users[r.conv_id]
        i = own.index(r.seq)
        need = own[i - 1] if i else None
        if r.conv_id is not None and r.conv_id % 3 == 0:
            need = own[1] if i == 0 else None if i == 1 and r.conv_id % 9 else need
        assert json.loads(r.arguments).get("after") == (None if need is None else f"call_{need}")
        seen += 1
    assert seen >= sum(map(len, users.values()))


def test_arguments_that_do_not_parse_are_kept(spark):
    rows = [(1, 0, "call", "a", "search", "{broken", None, 0), (1, 1, "call", "a", "search", '{"query":"y","limit":2}', None, 0), (1, 2, "result", "z", "tool", None, "lost", 0)]
    got = {tuple(r)[3:6]: r.json for r in chat.linked(spark.createDataFrame(rows, MESSAGES), chat.SCHEMAS).collect()}
    assert got[0, "call", "a"] == '{"arguments":"{broken","content":null,"id":"a","name":"search","valid":false}'
    assert got[1, "message", "a"] == '{"arguments":{"limit":2,"query":"y"},"content":null,"id":"a","role":"search"}'
    assert got[2, "orphan", "z"] == '{"content":"lost","id":"z","role":"tool"}'


def test_every_message_of_the_query_is_accounted_for(spark):
    rng = random.Random(3)
    turns = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["one", "two words", 'a "q"', None, "", "x" * 35])) for c in [*range(40), None] for t in range(rng.randrange(1, 9))]
    messages = chat.from_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    n = {r[0]: r[1] for r in messages.groupBy("kind").count().collect()}
    found = {r[0]: r[1] for r in chat.linked(messages, chat.SCHEMAS).groupBy("kind").count().collect()}
    answered = chat.linked(messages, chat.SCHEMAS).where("answered").count()
    assert sum(found.values()) + answered == sum(n.values())
    assert chat.linked(messages, chat.SCHEMAS).where("sub > 0").count() > 0 and chat.linked(messages.limit(0), chat.SCHEMAS).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(2)
    text = lambda n, kinds=3000: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    item = text(30)
    rows = [(k, text(120), "en", "s", 1) for k in range(40)]
    rows += [(100, rows[3][1], "en", "s", 1), (101, "12 34", None, "s", 1), (102, None, None, None, None), (103, text(40) + " " + item, "en", "s", 1), (104, text(60) + ' token = "0123456789abcdef0123456789abcdef"', "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [{r[0] for r in rows} - {101, 102}, {r[0] for r in rows} - {100, 101, 102}, {r[0] for r in rows} - {100, 101, 102, 103}]
    for (name, stage), ids in zip(cp.STAGES, kept):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in docs.collect()} == ids
    clean = cp.redact_secrets(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and "0123456789abcdef" not in clean.where("doc_id = 104").first().text
    assert clean.count() == len(kept[2])
    out = cp.tokenise(spark, clean, str(tmp_path))
    assert out.columns[0] == "doc_id" and out.count() == len(kept[2])


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows, nulls in every column and clashing names."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars int, score double, spans string, lang_pred string, keys string, fp long, at string"
    spark.createDataFrame([(1, "an item of the benchmark that is long enough to be found")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    more = (0.5, "s", "l", "k", 1, "a")
    rows = [(None, None, None, None, None, *more), (None, "some words without an id", "en", None, None, *more), (5, "some words here and there", None, None, 3, None, None, None, None, None, None), (5, "some words here and there", None, None, 3, None, None, None, None, None, None)]
    for table_ in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table_
        for name, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == table_.columns and [f.dataType for f in docs.schema] == [f.dataType for f in table_.schema], name
        left = [(r[0], r[1]) for r in rows if r[1]] if table_.count() else []
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(left, key=str)
        assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
