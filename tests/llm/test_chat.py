import hashlib
import re

from pyspark.sql import functions as F

from twinframe.llm import chat

TRICKY = [
    "</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "a\\b\\\\c\\", "<<SYS>> x <</SYS>>", "", "\n", "<|im_end|>",
    "<", "[", "\\<|im_end|>", "<\\|im_end|>", "é😀 $0 \\1", "<|endoftext|><s>", "<<|im_end|>\n", "x" * 100_000,
]


def rendered(turns):
    return chat.formatted(turns).select(
        "key", "formatted", "loss", chat.read_back(F.col("formatted")).alias("turns"),
        chat.under_mask(F.col("formatted"), F.col("loss")).alias("learned"))


def test_round_trip_of_control_strings(spark):
    rows = [(i, t, r, x) for i in range(3) for t, (r, x) in enumerate(
        (("system", "assistant", "user\nx", "<|im_start|>", "assistant")[(i + k) % 5], text) for k, text in enumerate(TRICKY))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.key: r for r in rendered(chat.canonical_turns(table)).collect()}
    for i in range(3):
        wanted = [(r, x) for c, _, r, x in rows if c == i]
        assert [(t.role, t.text) for t in got[i].turns] == wanted
        assert got[i].learned == "".join(x for r, x in wanted if r == "assistant")
        inside = got[i].formatted.split("<|im_end|>\n")
        assert len(inside) == len(wanted) + 1 and inside[-1] == ""
        for body in inside[:-1]:
            assert not re.search(r"<\|im_|<s>|</s>|\[/?INST\]|<<SYS>>|<</SYS>>|<\|endof", body.removeprefix("<|im_start|>"))
        for start, width in got[i].loss:
            assert got[i].formatted[start + width:].startswith("<|im_end|>\n")


def test_layouts_by_fingerprint(spark):
    plain = spark.createDataFrame([
        (1, "p", "r", None, None, None, None, 7), (2, None, None, "i", None, "o", None, 7),
        (3, None, None, "i", "n", "o", None, 7), (4, "p", "r", None, None, None, "s", 7), (5, None, None, None, None, None, None, 7)],
        "conv_id long, prompt string, response string, instruction string, input string, output string, system string, n int")
    got = {}
    for r in chat.canonical_turns(plain).orderBy("key", "n").collect():
        got.setdefault(r.key, []).append((r.role, r.text))
    assert got == {
        1: [("user", "p"), ("assistant", "r")], 2: [("user", "i"), ("assistant", "o")],
        3: [("user", "i\n\nn"), ("assistant", "o")], 4: [("system", "s"), ("user", "p"), ("assistant", "r")],
        5: [("unknown", "")]}
    nested = spark.sql("""
      SELECT 1L AS conv_id, array(named_struct('from', 'human', 'value', 'a'), named_struct('from', 'gpt', 'value', 'b')) AS conversations,
             'extra' AS role UNION ALL SELECT 2L, NULL, 'x' UNION ALL SELECT 3L, array(named_struct('from', NULL, 'value', NULL)), 'x'""")
    got = sorted((r.key, r.n, r.role, r.text) for r in chat.canonical_turns(nested).collect())
    assert got == [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "unknown", ""), (3, 1, "", "")]
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b"]) == hashlib.sha256(b"a\nb").hexdigest()


def test_records_with_missing_or_further_fields(spark):
    table = spark.sql("""
      SELECT *, IF(conv_id = 5, array(), IF(conv_id = 6, array(named_struct('role', 'bot', 'content', 'm')), NULL)) AS messages
      FROM VALUES (1L, 'p', NULL, NULL, NULL, NULL), (2L, NULL, NULL, 'i', NULL, NULL), (3L, 'p', 'r', NULL, 'x', NULL),
        (4L, NULL, NULL, NULL, 'x', NULL), (5L, NULL, NULL, NULL, NULL, NULL), (6L, 'p', NULL, NULL, NULL, NULL),
        (7L, 'p', NULL, NULL, NULL, 's'), (8L, NULL, NULL, NULL, NULL, NULL)
        AS t(conv_id, prompt, response, instruction, input, system)""")
    got = {}
    for r in chat.canonical_turns(table).orderBy("key", "n").collect():
        got.setdefault(r.key, []).append((r.role, r.text))
    # The schema has no `output`, so no layout holds `instruction` and `input`.
    assert got == {
        1: [("user", "p"), ("assistant", "")], 2: [("unknown", "i")],
        3: [("user", "p"), ("assistant", "r"), ("unknown", "x")], 4: [("unknown", "x")], 5: [("unknown", "")],
        6: [("assistant", "m"), ("unknown", "p")], 7: [("system", "s"), ("user", "p"), ("assistant", "")], 8: [("unknown", "")]}
    short = spark.sql("SELECT 1L AS conv_id, 'i' AS instruction, '' AS input, CAST(NULL AS STRING) AS output")
    got = [(r.role, r.text) for r in chat.canonical_turns(short).orderBy("n").collect()]
    assert got == [("user", "i"), ("assistant", "")]


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x"), (1, 0, "user", None), (1, 0, "assistant", "b"), (None, 0, "user", "n")]
    table = spark.createDataFrame([(*r, 9, "y") for r in rows], "conv_id long, turn long, role string, text string, n int, key string")
    got = {r.key: [(t.role, t.text) for t in r.turns] for r in rendered(chat.canonical_turns(table)).collect()}
    assert got == {1: [("", "x"), ("assistant", "b"), ("user", ""), ("user", "")], None: [("user", "n")]}
    assert rendered(chat.canonical_turns(table.limit(0))).count() == 0
    none = rendered(chat.canonical_turns(table.filter("role = 'user' AND conv_id = 1"))).first()
    assert none.learned == "" and none.loss == []


def test_plan_is_native(spark):
    table = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = rendered(chat.canonical_turns(table))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and plan.count("Exchange hashpartitioning") == 1


def test_every_layout_may_have_a_system_text(spark):
    for asked, answered in (("prompt", "response"), ("prompt", "completion"), ("question", "answer"), ("instruction", "output")):
        record = spark.sql(f"SELECT 1L AS conv_id, 's' AS system, 'q' AS {asked}, 'a' AS {answered}")
        got = [(r.role, r.text) for r in chat.canonical_turns(record).orderBy("n").collect()]
        assert got == [("system", "s"), ("user", "q"), ("assistant", "a")]
    record = spark.sql("SELECT 1L AS conv_id, 's' AS system, 'q' AS instruction, 'i' AS input, 'a' AS output")
    got = [(r.role, r.text) for r in chat.canonical_turns(record).orderBy("n").collect()]
    assert got == [("system", "s"), ("user", "q\n\ni"), ("assistant", "a")]
    assert len({chat.fingerprint(known.paths) for known in chat.LAYOUTS}) == len(chat.LAYOUTS)
