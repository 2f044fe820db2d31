"""Symbols of process models and document templates by cases, and streams with state against the whole."""

import datetime as dt
import random

import pytest

from tessera.functions import extract, models
from tessera.streaming import answers

HEAD = '<definitions xmlns:b="http://x">\n'
MODEL = (
    HEAD
    + """<b:process id="order">
<b:startEvent id="s"/>
<b:userTask id="t1" name="Check order"><extensionElements/></b:userTask>
<b:sequenceFlow id="f1"/>
<b:sequenceFlow id="f2"/>
<b:subProcess id="sub" name="Pay">
  <b:serviceTask id="t2"/>
  <b:sequenceFlow id="f3"/>
  <b:sequenceFlow id="f4"><conditionExpression>x</conditionExpression></b:sequenceFlow>
  <b:sequenceFlow id="f5"/>
  <b:endEvent id="e" name="Paid"/>
</b:subProcess>
<b:sequenceFlow id="f6"/>
<b:exclusiveGateway id="g"/>
<b:sequenceFlow id="f7"/>
<b:sequenceFlow id="f8"/>
<b:sequenceFlow id="f9"/>
</b:process>
<BPMNDiagram id="d">
<shape/>
</BPMNDiagram>
</definitions>"""
)


def test_process_symbols():
    assert list(models.process_symbols(MODEL)) == [
        ("Check order", "userTask", "order", 4, 4),
        ("Pay", "subProcess", "order", 7, 13),
        ("t2", "serviceTask", "Pay", 8, 8),
        ("sequence flows", "sequenceFlows", "Pay", 9, 11),
        ("Paid", "endEvent", "Pay", 12, 12),
        ("g", "exclusiveGateway", "order", 15, 15),
        ("sequence flows", "sequenceFlows", "order", 16, 18),
        ("diagram", "diagram", "", 20, 22),
    ]
    assert list(models.process_symbols(" \n")) == list(models.process_symbols(None)) == []
    with pytest.raises(ValueError, match="no element|unclosed|mismatched"):
        list(models.process_symbols(HEAD + '<process id="p"><task id="t"/>'))
    assert [r[5] != "" for r in models.process_rows("<a><b></a>")] == [True]


def symbols(path, *lines):
    return list(models.template_symbols(path, "\n".join(lines)))


def test_template_symbols():
    got = symbols("mail/#Letter.v2.mtxm", "﻿.DSC Projekt: x", ".DSC ---", ".dsc %Label0012; Payment reminder", "Dear,", ".IF due > 30", ".table a", ".WHILE x", ".END", ".ELS", ".END", ".FOREACH", "..", ".end", ".EOJ", ".DSC TEXT BEGIN", "x", ".DSC TEXT END")
    scope = "Letter.v2: Payment reminder"
    assert got == [("Letter.v2", "textblock", "Payment reminder", 1, 4), ("due > 30", "if", scope, 5, 10), ("foreach", "foreach", scope, 11, 13), ("Letter.v2", "preview", scope, 15, 17)]
    # layout closes by its own end, a stray one closes nothing, comments close nothing
    assert symbols("a.mtxt", "x", ".TABLE w=1", ".TEXTFRAME", ".TABLE END", ".DSC .END", ".TEXTFRAME END", ".TABLE END", ".TABLE END")[1:] == [("w=1", "table", "a", 2, 7)]
    # an end of nothing, or a block that stays open: only the head, its title from before the first block
    for tail in ((".END", ".END"), ()):
        assert symbols("a.mtxt", ".DSC Title", ".IF x", *tail, ".DSC TEXT END") == [("a", "template", "Title", 1, 3 + len(tail))]
    # a block at the very top belongs to the head, which then ends before the next one
    assert symbols("a.mtxt", "", ".IF x", ".END", ".DSC In time", ".WITH y", ".END") == [("a", "template", "In time", 1, 4), ("y", "with", "a: In time", 5, 6)]
    assert symbols("a.mtxt", " ", "") == [] and models.title_of(iter(["", "%label1;", "GUI x", "#a", "Ü"])) == "Ü"


def pieces_of(rng, i, text):
    cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(12))})
    parts = [text[a:b] for a, b in zip(cuts, cuts[1:])] or [""]
    return [(i, s, p, 5, s == len(parts) - 1) for s, p in enumerate(parts)]


def test_streamed_answers_equal_the_whole_after_restarts(spark, tmp_path):
    rng = random.Random(6)
    texts = {i: "".join(rng.choice(["[3]", "[1, 2]", "word ", "\n", "```\n", "[9]", "[", "]", "~~~\n", "5"]) for _ in range(40)) for i in range(8)} | {8: "", 9: "x"}
    rows = [p for i, t in texts.items() for p in pieces_of(rng, i, t)]
    order = sorted(rows, key=lambda r: r[1] + rng.random() * 3)  # some come before the ones before them
    for lo in range(0, len(order), 30):
        spark.createDataFrame(order[lo : lo + 30], answers.PIECES).write.mode("append").parquet(f"{tmp_path}/landed")
        answers.landed(spark, f"{tmp_path}/landed", answers.PIECES, answers.renumbered, f"{tmp_path}/out", f"{tmp_path}/offsets")
    out = spark.read.schema(answers.READY).parquet(f"{tmp_path}/out").collect()
    assert len(out) == len(rows)
    for i, text in texts.items():
        own = sorted((r.seq, r.text, r.numbers) for r in out if r.answer_id == i)
        assert ("".join(t for _, t, _ in own), own[-1][2]) == extract.renumber(text, 5)


def test_usage_meter_closes_and_gives_up(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    landings = [
        [(1, "a", at(0), 10, 1, None, False), (2, "a", at(1), 7, 1, 3, False), (1, "b", at(2), 5, 2, 4, False)],
        [(1, "c", at(3), 1, 1, None, True), (3, "a", at(50), 2, 2, None, False)],  # 2 is silent for longer than the patience
        [(3, "b", at(51), 2, 2, None, True), (4, "a", at(200), 1, 1, None, True)],
        [(5, "a", at(400), 1, 1, None, True)],
    ]
    for rows in landings:
        spark.createDataFrame(rows, answers.CALLS).write.mode("append").parquet(f"{tmp_path}/landed")
        answers.landed(spark, f"{tmp_path}/landed", answers.CALLS, answers.metered, f"{tmp_path}/out", f"{tmp_path}/offsets")
    got = {r.turn: (r.calls, r.prompt, r.completion, r.cached, r.abandoned) for r in spark.read.schema(answers.METER).parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (3, 16, 4, 4, False), 2: (1, 7, 1, 3, True), 3: (2, 4, 4, None, False), 4: (1, 1, 1, None, False), 5: (1, 1, 1, None, False)}
