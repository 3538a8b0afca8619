import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import chat, queries

ALPHABET = st.text(st.sampled_from("\\<|[]/>sINSTturnend\n é"), max_size=40) | st.lists(st.sampled_from(
    ["<|turn|>", "<|says|>", "<|end|>\n", "[INST]", "[/INST]", "<s>", "</s>", "\\", "<", "[", "x"])).map("".join)


@settings(max_examples=400, deadline=None)
@given(ALPHABET, ALPHABET)
def test_escape_is_reversible_and_leaves_no_control_string(role, text):
    segment, start, end = chat.render(role, text)
    assert chat.parse(segment) == (role, text)
    assert chat.unescape(segment[start:end]) == text
    for mark in ("<|", "[INST]", "[/INST]", "<s>", "</s>"):
        assert mark not in chat.escape(text)


def by_definition(events):
    out = {}
    for conv in {e[0] for e in events}:
        turns = []  # [turn, role, text]
        log = sorted((e for e in events if e[0] == conv), key=lambda e: tuple((x is not None, x or 0) if isinstance(
            x, (int, type(None))) else (True, x) for x in (e[1],)))
        for _, _, kind, turn, role, text in log:
            numbers = [t[0] for t in turns]
            if kind == "message":
                at = turn if turn is not None else max(numbers, default=-1) + 1
                turns = [t for t in turns if t[0] != at] + [[at, role or "", text or ""]]
            elif kind in ("delta", "edit", "regenerate"):
                at = turn if turn is not None else max(numbers, default=0)
                if kind == "delta" and at not in numbers:
                    turns.append([at, role or "assistant", ""])
                for t in turns:
                    if t[0] == at:
                        t[2] = (t[2] if kind == "delta" else "") + ("" if kind == "regenerate" else text or "")
                if kind != "delta" and at in numbers:
                    turns = [t for t in turns if t[0] <= at]
        if turns:
            out[conv] = [(r, t) for _, r, t in sorted(turns)]
    return out


def test_folding_deltas_edits_and_regenerations(spark):
    rng = random.Random(1)
    events = []
    for conv in [*range(30), None]:
        for seq in range(rng.randrange(1, 25)):
            events.append((conv, seq, rng.choice(["message", "delta", "delta", "edit", "regenerate", None, "other"]),
                           rng.choice([None, None, 0, 1, 2, 5]), rng.choice(["user", "assistant", None]),
                           rng.choice([None, "", "a", "</s>b", "é\n"])))
    rng.shuffle(events)
    frame = spark.createDataFrame([(*e, 1) for e in events],
                                  "conv_id long, seq long, kind string, turn long, role string, text string, n int")
    got = {}
    for r in chat.format_events(frame).collect():
        got.setdefault(r.conv_id, []).append((r.n, *chat.parse(r.segment)))
        assert (r.loss_from is not None) == (chat.parse(r.segment)[0] == "assistant")
    assert {c: [x[1:] for x in sorted(m)] for c, m in got.items()} == by_definition(events)
    assert chat.digests(chat.format_events(frame.limit(0))).count() == 0


def test_streamed_answer(spark):
    log = [(1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, None, "Hel"), (1, 2, "delta", 1, None, "lo"),
           (1, 3, "message", 2, "user", "more"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, None, "Bye"),
           (1, 6, "edit", 0, None, "hey")]
    frame = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    assert [chat.parse(r.segment) for r in chat.format_events(frame).collect()] == [("user", "hey")]
    before = chat.format_events(frame.filter("seq < 6")).collect()
    assert [chat.parse(r.segment) for r in before] == [("user", "hi"), ("assistant", "Bye")]


def test_query_reads_the_hostile_conversation_back(spark):
    rows = {r.conv_id: r for r in queries.op3_chat(spark, "/root/testdata/sf0.001").collect()}
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(queries.HOSTILE)


def test_time_grows_in_proportion_with_a_conversation():
    def seconds(n):
        state, start = chat.Conversation(), time.perf_counter()
        for i in range(n):
            state.apply("message", None, "user", "x")
            if i % 3 == 0:
                state.apply("edit", max(0, i // 2), None, "y")
        return time.perf_counter() - start, len(state.order)

    seconds(1000)
    (short, _), (long, _) = min(seconds(20_000) for _ in range(3)), min(seconds(200_000) for _ in range(3))
    assert long < 30 * short


def test_a_long_conversation_comes_out_whole(spark, monkeypatch):
    monkeypatch.setattr(chat, "BATCH_ROWS", 700)
    events = spark.range(20_000).selectExpr(
        "7L as conv_id", "id as seq", "'message' as kind", "cast(null as long) as turn",
        "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    segments = chat.format_events(events).collect()
    assert [r.n for r in segments] == list(range(20_000))
    assert [chat.parse(r.segment)[1] for r in segments] == [f"t{n}" for n in range(20_000)]
    assert chat.digests(chat.format_events(events)).first().n_turns == 20_000
