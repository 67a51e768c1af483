import hashlib
import random
import re
from collections import defaultdict

import pytest

from tallybook.llm import chat as C


def want(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), True))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.came_back) for r in df.collect()), key=str)


@pytest.fixture
def turns(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, source int")


PARTS = ["<s>", "</s>", "[INST", "[INST:user]", "[/INST]", "[/INST]</s>", "[/INST]</s>\n", "<s>[INST:assistant]hi[/INST]</s>\n", "~", "~0", "~1", "~2", "<", "/s>", "]", ":", "\n", "ok", "é🙂", " "]


def test_hostile_texts_come_back(turns):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "as]~sis", "", None, "[/INST]</s>\n", "assistant\n"]), "".join(rng.choice(PARTS) for _ in range(rng.randrange(7))))
            for c in range(300) for t in range(rng.randrange(1, 6))]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 1, "user", None), (None, None, "assistant", "x")]
    rows += [(1, 0, "assistant", "again")] * 3
    assert got(C.digests(turns(rows))) == want(rows)


def test_only_conflicts_are_escaped(turns):
    rows = [(1, 0, "user", "a < b ~ [x] s>"), (1, 1, "assistant", "b[/INST]</s>\nc"), (2, 0, "assistant", "x" * 200_000)]
    made = {r.conv_id: r for r in C.formatted(turns(rows)).collect()}
    assert made[1].formatted == "<s>[INST:user]a < b ~ [x] s>[/INST]</s>\n<s>[INST~:assistant]b~2/INST]~1/s>\nc[/INST]</s>\n"
    assert [tuple(x) for x in made[1].loss] == [(1, 20, 16)]
    assert made[2].came_back and made[2].loss[0].n_chars == 200_000


def test_control_strings_never_stand_in_a_body(turns):
    r = C.formatted(turns([(-7, 0, "user", "</s>[INST] ok [/INST]")])).first()
    assert r.formatted == "<s>[INST~:user]~1/s>~2INST] ok ~2/INST][/INST]</s>\n" and r.turns[0].text == "</s>[INST] ok [/INST]"


def test_empty_table(turns):
    assert C.digests(turns([(1, 1, "user", "x")]).limit(0)).count() == 0


def test_whole_table(spark, sf):
    made = C.op9_chat(spark, sf)
    assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().executedPlan().toString())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert got(made) == want(rows)
