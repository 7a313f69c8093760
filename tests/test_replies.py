import json

import pytest
from pyspark.sql import functions as F

from samplelake.functions.replies import clean_json, extract_fenced, field, has_fields, parse_lenient, parse_quoted
from samplelake.functions.reply_text import read_reply
from samplelake.operators.infer import infer, parse_replies

# text, and the object it holds (None: no JSON)
REPLIES = [
    ('Sure.\n```json\n{"a": 1}\n```\nBye\n```json\n{"a": 2}\n```', {"a": 1}),
    ('{"a": true}', {"a": True}),
    ('```JSON\n{"a": True, "b": [False, True]}\n```', {"a": True, "b": [False, True]}),
    ('```json\n{"a": "x", // why\n "b": 2 // end\n}\n```', {"a": "x", "b": 2}),
    ('{"u": "http://x.y//z", "t": "it is: True // or not", "c": True} // note', {"u": "http://x.y//z", "t": "it is: True // or not", "c": True}),
    (r'{"q": "say \"True\" // no", "f": False}', {"q": 'say "True" // no', "f": False}),
    ('```json\n{"a": \n```', None),
    ("no json at all", None),
    ('```jsonc\n{"a": 1}\n```', None),
]


def test_clean_json(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPLIES)], "i int, t string")
    parsed = df.select("i", clean_json(F.col("t")).alias("c"), F.to_json(parse_lenient(F.col("t"))).alias("v"))
    for r in parsed.collect():
        want = REPLIES[r["i"]][1]
        assert (None if r["v"] is None else json.loads(r["v"])) == want, REPLIES[r["i"]]
        if want is not None:
            assert json.loads(r["c"]) == want


@pytest.mark.parametrize("text,want", REPLIES)
def test_in_task_reading_agrees(text, want):
    if want is None:
        with pytest.raises(ValueError):
            read_reply(text)
    else:
        assert read_reply(text) == want


def test_replies_that_no_column_can_hold():
    from samplelake.functions.reply_text import read_reply

    for text in ('{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1e999}', '{"a": {"b": 1, "b": 1}}', "[1]"):
        with pytest.raises(ValueError):
            read_reply(text)
    assert read_reply('{"a": 1.5, "b": {"a": true}}') == {"a": 1.5, "b": {"a": True}}


def test_calls_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr("samplelake.operators.infer.TASK_PROMPTS", 20)
    monkeypatch.setattr("samplelake.operators.infer.RUN_PROMPTS", 200)
    prompts = spark.range(500).selectExpr("cast(id as string) AS prompt_key", "concat('p', id) AS prompt").coalesce(1)
    replies = infer(prompts, lambda p: json.dumps({"n": p}))
    assert replies.count() == 500 and len(replies.inputFiles()) >= 20
    assert len({f.rsplit("/", 2)[1] for f in replies.inputFiles()}) == 2


def test_language_tag_ends_with_the_word(spark):
    text = "```rust\nfn\n```\n```R\nx <- 1\n```"
    row = spark.createDataFrame([(text,)], "t string").select(
        extract_fenced(F.col("t"), "r").alias("r"), extract_fenced(F.col("t"), "sql").alias("s")).first()
    assert row["r"] == "x <- 1" and row["s"] == text


def test_single_quotes(spark):
    df = spark.createDataFrame([("{'a': 'x', 'n': 1}",), ('{"a": "y"}',), ("{bad",)], "t string")
    got = [r[0] for r in df.select(F.to_json(parse_quoted(F.col("t")))).collect()]
    assert [json.loads(g) if g else None for g in got] == [{"a": "x", "n": 1}, {"a": "y"}, None]


def test_fields(spark):
    text = '{"organ/tissue": "lung", "n": 3, "none": null, "flag": true, "it\'s": "x", "say \\"it\'s\\"": "z", "many": ["a", 1]}'
    v = F.try_parse_json(F.lit(text))
    row = spark.range(1).select(
        field(v, "organ/tissue").alias("a"), field(v, "n").alias("b"), field(v, "none").alias("c"), field(v, "gone").alias("d"),
        field(v, "it's").alias("e"), field(v, "many").alias("f"),
        field(v, 'say "it\'s"').alias("i"),
        has_fields(v, {"flag": "boolean", "n": "int"}).alias("g"), has_fields(v, {"organ/tissue": "boolean"}).alias("h"),
    ).first()
    assert tuple(row) == ("lung", "3", None, None, "x", '["a",1]', "z", True, False)


class Model:
    """Counts its calls in a file, so that calls from worker processes are seen."""

    def __init__(self, log, script):
        self.log, self.script = str(log), script

    def __call__(self, prompt):
        with open(self.log, "a") as f:
            f.write(prompt + "\n")
        with open(self.log) as f:
            nth = f.read().splitlines().count(prompt)
        return self.script(prompt, nth)

    def calls(self):
        with open(self.log) as f:
            return sorted(f.read().splitlines())


def _script(prompt, nth):
    if prompt == "third":
        return "nothing" if nth < 3 else '{"ok": true}'
    if prompt == "never":
        return "nothing"
    if prompt == "boom":
        raise RuntimeError("down")
    if prompt == "list":
        return "[1]"
    return '{"ok": true}'


def test_infer_retries_and_caches(spark, tmp_path):
    model = Model(tmp_path / "calls", _script)
    asked = ["fine", "fine", "third", "never", "boom", "list"]
    prompts = spark.createDataFrame([(p, p) for p in asked], "prompt_key string, prompt string").coalesce(1)
    store = str(tmp_path / "store")
    first = {r["prompt_key"]: r for r in infer(prompts, model, store=store).collect()}
    assert sorted(first) == ["boom", "fine", "list", "never", "third"]
    assert (first["fine"]["attempt"], first["fine"]["error"]) == (1, None)
    assert (first["third"]["attempt"], first["third"]["error"]) == (3, None)
    assert first["never"]["attempt"] == 3 and "unreadable" in first["never"]["error"]
    assert first["boom"]["error"] == "RuntimeError: down" and first["boom"]["text"] is None
    assert model.calls() == sorted(["fine", "third", "third", "third", "never", "never", "never", "boom", "list", "list", "list"])

    again = {r["prompt_key"]: r["error"] for r in infer(prompts, model, store=store).collect()}
    assert sorted(again) == sorted(first)
    assert model.calls().count("fine") == 1 and model.calls().count("third") == 3
    assert model.calls().count("boom") == 2

    good = prompts.filter("prompt in ('fine', 'third')")
    before = len(model.calls())
    assert infer(good, model, store=store).count() == 2
    assert len(model.calls()) == before


def test_error_marker_and_validator(spark, tmp_path):
    prompts = spark.createDataFrame([("a", "a")], "prompt_key string, prompt string")
    told = infer(prompts, lambda p: '{"m": "an Error"}', error_marker="Error").first()
    assert "Error" in told["error"]
    assert infer(prompts, lambda p: '{"m": "an Error"}').first()["error"] is None
    refused = infer(prompts, lambda p: '{"m": 1}', lambda v: "ok" in v, retries=2).first()
    assert refused["attempt"] == 2 and refused["error"] == "the reply was not accepted"
    taken = infer(prompts, lambda p: "plain text here", check=False).first()
    assert (taken["text"], taken["n_tokens_in"], taken["n_tokens_out"]) == ("plain text here", 1, 3)


def test_parse_replies(spark):
    data = [("a", '{"x": 1}', None), ("b", "[1]", None), ("c", "zzz", None), ("d", '{"x": 1}', "failed")]
    got = parse_replies(spark.createDataFrame(data, "prompt_key string, text string, error string"))
    assert {r["prompt_key"]: (r["valid"], r["v"]) for r in got.select("prompt_key", "valid", F.to_json("value").alias("v")).collect()} == {
        "a": (True, '{"x":1}'), "b": (False, None), "c": (False, None), "d": (False, None)}


def test_calls_in_flight_are_bounded_and_in_order():
    import threading
    import time

    from samplelake.operators.infer import in_order

    lock, now, most = threading.Lock(), 0, []

    def slow(i):
        nonlocal now
        with lock:
            now += 1
            most.append(now)
        time.sleep(0.02 * (3 - i % 3))
        with lock:
            now -= 1
        return i * i

    for k in (1, 2, 5):
        most.clear()
        begun = time.time()
        assert list(in_order(slow, range(30), k)) == [i * i for i in range(30)]
        assert max(most) == k and time.time() - begun < 1.8 / k + 0.6

    # Items are taken as there is room for them.
    taken = []
    replies = in_order(lambda i: i, (taken.append(i) or i for i in range(100)), 3)
    assert next(replies) == 0 and len(taken) <= 4
    with pytest.raises(ZeroDivisionError):
        list(in_order(lambda i: 1 // (5 - i), range(9), 3))


def test_many_calls_at_once_in_a_task(spark, tmp_path):
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(40)], "prompt_key string, prompt string")

    def model(prompt):
        import time

        time.sleep(0.1)
        return json.dumps({"n": prompt})

    import time

    begun = time.time()
    got = infer(prompts, model, parallel=1, in_flight=20)
    assert got.count() == 40 and time.time() - begun < 40 * 0.1
    with pytest.raises(ValueError, match="in_flight"):
        infer(prompts, model, in_flight=0)


def test_runs_read_their_own_prompts(spark, tmp_path, monkeypatch):
    from samplelake.operators import infer as module
    from samplelake.operators.summary import Summary

    monkeypatch.setattr(module, "RUN_PROMPTS", 10)
    prompts = spark.createDataFrame([(str(i), f"p {i}") for i in range(45)] * 2, "prompt_key string, prompt string")
    summary, store = Summary(), str(tmp_path / "store")

    def model(prompt):
        return "odd" if prompt.endswith("7") else json.dumps({"n": prompt})

    assert infer(prompts, model, store=store, retries=2, summary=summary).count() == 45
    assert len(list((tmp_path / "store").glob("run=*"))) == 4
    told = {(r["item"], r["metric"]): r["n"] for r in summary.table(spark).collect()}
    assert told == {
        ("prompts", "rows"): 45, ("replies", "rows"): 45, ("replies", "errors"): 4, ("replies", "calls"): 49,
        ("replies", "tokens_in"): 90, ("replies", "tokens_out"): 41 * 3 + 4,
    }
    again = Summary()
    assert infer(prompts, lambda p: json.dumps({"n": 1}), store=store, summary=again).count() == 45
    told = {(r["item"], r["metric"]): r["n"] for r in again.table(spark).collect()}
    assert told["prompts", "rows"] == 4 and told["stored replies", "rows"] == 41


def test_runs_are_whole_files_of_bounded_size(spark, monkeypatch):
    from samplelake.operators import infer as module

    monkeypatch.setattr(module, "RUN_PROMPTS", 100)
    seen = []
    told = module._runs
    monkeypatch.setattr(module, "_runs", lambda stored, path: seen.append((stored, told(stored, path))) or seen[-1][1])
    prompts = spark.range(1050).selectExpr("cast(id as string) AS prompt_key", "concat('p ', id) AS prompt").coalesce(1)
    got = infer(prompts, lambda p: json.dumps({"n": p}), parallel=4)
    stored, runs = seen[0]
    # No run is dealt by one task: what is stored are files of a tenth of a run.
    assert stored.groupBy("_metadata.file_name").count().agg(F.max("count")).first()[0] <= 10
    assert len(runs) == 10 and all(90 <= n <= 120 and df.count() == n for n, df in runs)
    assert got.select("prompt_key").distinct().count() == got.count() == 1050
