import hashlib
from collections import defaultdict

from tallyforge.llm import chat_views


def plain(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r or "unknown", x or ""))
    out = {}
    for c, turns in convs.items():
        for speaker in {r for _, r, _ in turns} - {"system"}:
            text, masks = "", []
            for _, role, said in sorted(turns, key=lambda t: (t[0], t[1], hashlib.md5(t[2].encode()).hexdigest(), t[2])):
                text += "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == speaker else f"<|user name={role}|>\n"
                if role == speaker:
                    masks.append((len(text), len(text) + len(said) + len(chat_views.END)))
                text += said + chat_views.END
            out[c, speaker] = (text, masks)
    return out


def check(got, rows):
    out = defaultdict(lambda: ["", []])
    for r in sorted(got, key=lambda r: (r.part, r.piece)):
        at = out[r.conv_id, r.speaker]
        at[1] += [(m.begin + len(at[0]), m.end + len(at[0])) for m in r.masks]
        at[0] += r.text
        assert r.n_masked == sum(m.end - m.begin for m in r.masks)
    assert {k: tuple(v) for k, v in out.items()} == plain(rows)


def test_table_and_parts(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    check(chat_views.perspectives(turns).collect(), rows)
    check(chat_views.perspectives(turns, part_turns=2).collect(), rows)


def test_edges(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "é😀"), (1, 2, "bob", None), (1, 3, None, "x"), (1, 2, "bob", "again"), (1, 2, "bob", "again"), (2, 0, "system", "only"),
            (None, 0, "ann", "lost"), (3, None, "ann", "first"), (3, 5, "cy", "y" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, part int, speaker string")
    check(chat_views.perspectives(df).collect(), rows)
    assert chat_views.perspectives(df.limit(0)).count() == 0


def test_parts_of_many_turns_are_cut_into_pieces(spark):
    rows = [(1, None, "ann", f"x{i % 7}") for i in range(50)] + [(1, 3, "bob", "same")] * 40 + [(1, 4, "bob" if i % 3 else "cy", f"t{i}") for i in range(30)] + [(None, 2, "di", "lost")] * 25 + [(2, 2, "ann", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_views.perspectives(df, part_turns=8).collect()
    check(got, rows)
    assert max(r.n_turns for r in got) == 8
    assert {(r.part, r.piece) for r in got if r.conv_id == 1} == {(-1, k) for k in range(7)} | {(0, k) for k in range(9)}
    # pieces but the last of a part are full
    for r in got:
        if r.n_turns < 8:
            assert not any(o.conv_id == r.conv_id and o.part == r.part and o.piece > r.piece for o in got)
