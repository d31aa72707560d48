import pytest

from rolloutlake.llm import replies as r

PROMPT = "Which object made the rapid hiss heard at 61:01 - 61:29, the folded marble or the slate fan left in the harbour?"


@pytest.fixture(scope="module")
def model():
    texts = [f"It came from the {n}, which moved the {a} edge while the wearer was lifting." for n in ("bell", "fan", "jar", "cup") for a in ("steel", "clay", "wet", "tin", "dry")] * 30
    texts += ["A wet fan.", "One", "On the jar to the right."] * 30
    counts = r.count_contexts(texts)

    def label(prompt, reply):
        kind = r.defect(prompt, reply, False, frozenset())
        if kind != "?":
            return kind
        return "truncated" if r.ends_broken([tuple(counts.get(c, (0, 0))) for c in r.last_contexts(reply)]) else None

    return label


@pytest.mark.parametrize(
    ("prompt", "reply", "kind"),
    [
        (PROMPT, None, "empty"),
        (PROMPT, " ​ ", "empty"),
        (PROMPT, "[no answer]", "empty"),
        (PROMPT, "...", "empty"),
        (PROMPT, "A voice says 'n/a' and then the jar gives a creak.", None),
        (PROMPT, "I'm sorry, but I cannot answer that question", "refusal"),
        (PROMPT, "I'm sorry about the noise in my first take: the crunch comes from the helmet.", None),
        (PROMPT, "It cannot be heard, since the jar covers it.", None),
        (PROMPT, "Unfortunately hidden behind the boot, but it is the flask.", None),
        (PROMPT, "Es tut mir leid, aber ich kann dabei nicht helfen.", "refusal"),
        (PROMPT, "Question: " + PROMPT.upper(), "copied"),
        (PROMPT, "61:01 - 61:29", None),
        (PROMPT, "Man hört zweimal, wie in der Halle etwas auf den Hocker fällt.", "language"),
        (PROMPT, "The label reads 'Bitte leise', and the fan next to it makes the snap.", None),
        (PROMPT, "It came from the bell, which moved the clay edge while the", "truncated"),
        (PROMPT, "It came from the bell, which moved the clay edge", "truncated"),
        (PROMPT, "It came from the bell, which moved the clay edge while the wearer was lifting", None),
        (PROMPT, "On the jar to the right. It came and then…", "truncated"),
        (PROMPT, "It came from the bell, which moved the clay ed", "truncated"),
        ("这段录音里的声音是从哪里来的？", "这段录音里的声音 是从哪里来的", "copied"),
        ("这段录音里，第二次敲击的声音是从哪里来的，是从门后还是窗边？", "第二次敲击的声音是从哪里来的，这段录音里，是从门后还是窗边？", "copied"),
        ("Why?", "why", "copied"),
        ("Which fan hums?", "The slate one.", None),
        (None, "It came from the bell, which moved the clay edge while the wearer was lifting.", None),
        ("", None, "empty"),
    ],
)
def test_kinds(model, prompt, reply, kind):
    assert model(prompt, reply) == kind


def test_zstandard_alone_decides_on_copies(monkeypatch):
    told = "the folded marble or the slate fan left in the harbour, which object made the rapid hiss heard at 61:01 - 61:29"
    assert r.copies_prompt(PROMPT, told)
    monkeypatch.setattr(r, "_ratio", lambda text, dictionary: 1.0)
    assert not r.copies_prompt(PROMPT, told)


def test_worked_solutions():
    sound = ["There are $12$ items. Taking away $2$ leaves $\\boxed{10}$.", "Taking away $2$ leaves $10$. So it is $\\boxed{10}$"] * 40
    model = r.rare_ends(r.count_worked([*sound, "There are $12$ items. Taking", "Taking away $2$ leaves $10$."]))
    task = "There are $3$ shelves with $4$ items each, and $2$ are handed out to the guests in the yard. How many items are left on them?"
    assert r.defect(task, "There are $12$ items. Taking away $2$ leaves $\\boxed{10}$", True, model) is None
    assert r.defect(task, "There are $12$ items. Taking away $2$ leaves $\\boxed{", True, model) == "truncated"
    assert r.defect(task, task + "\n\n" + "Taking away $2$ leaves $\\boxed{10}$.", True, model) is None
    assert r.defect(task, "> " + task, True, model) == "copied"
    assert r.defect(task, "把已知的数代入并化简，可得 $\\boxed{10}$。", True, model) == "language"


def test_frame(spark):
    rows = [(1, PROMPT, "n/a", False), (2, PROMPT, "A fan.", False), (2, PROMPT, "A fan.", False), (3, None, None, True), (4, PROMPT, "word " * 50_000 + ".", False)]
    df = spark.createDataFrame([(*x, "x") for x in rows], "row_id long, prompt string, reply string, worked boolean, defect string")
    assert {tuple(x) for x in r.label_replies(df).collect()} == {(1, "empty"), (3, "empty")}
    assert r.label_replies(df.limit(0)).collect() == []


def test_open_ends_are_looked_up_in_all_replies(spark, monkeypatch):
    texts = [f"It came from the {n}, which moved the {a} edge while the wearer was lifting." for n in ("bell", "fan", "jar", "cup") for a in ("steel", "clay", "wet", "tin", "dry")] * 30 + ["A wet fan."] * 20
    cut = ["It came from the bell, which moved the clay edge", "It came from the fan, which moved the st", "A wet fan"]
    df = spark.createDataFrame([(k, PROMPT, t, False) for k, t in enumerate(texts + cut)], "row_id long, prompt string, reply string, worked boolean").repartition(3)
    want = {(len(texts), "truncated"), (len(texts) + 1, "truncated")}
    assert {tuple(x) for x in r.label_replies(df).collect()} == want
    monkeypatch.setattr(r, "SENT", 0)
    assert {tuple(x) for x in r.label_replies(df).collect()} == want
