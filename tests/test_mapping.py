"""The mapping rules: one small document for each kind of element, what it must give, and what must not be there."""

import re

import pytest

from lattica.operators import mapping
from lattica.operators.mapping import NAMESPACES, RULES

N = {k: v for k, v in NAMESPACES.items()}
SUB = "<http://www.w3.org/2000/01/rdf-schema#subClassOf>"


def short(term):
    """Terms by prefix, for reading."""
    if term == SUB:
        return "a"
    for k, v in N.items():
        if term.startswith(f"<{v}"):
            return f"{k}:{term[len(v) + 1 : -1]}"
    return term.replace("<urn:e:", "<")


def document(inner):
    return f'<bpmn:definitions xmlns:bpmn="urn:b" xmlns:xsi="urn:xsi" xmlns:signavio="urn:s" id="D" name="N" exporter="x" xsi:schemaLocation="l">{inner}</bpmn:definitions>'.replace("<t:", "<bpmn:").replace("</t:", "</bpmn:")


IN_PROCESS = '<t:process id="P" name="Main">{}</t:process>'
IN_CHOREOGRAPHY = '<t:choreography id="C" isClosed="false">{}</t:choreography>'
CASES = {
    "process": ('<t:process id="P" name="Main"><t:subProcess id="S"/></t:process><t:error id="E" name="Bad"/>', {("<P>", "a", "bbo:Process"), ("<P>", "bbo:name", '"Main"'), ("<P>", "org:belongsToRAMILayer", "layer:Business"), ("<P>", "org:belongsToView", "org:BusinessProcessManagementView"), ("<S>", "a", "bbo:SubProcess"), ("<E>", "bbo:name", '"Bad"')}),
    "tasks": (IN_PROCESS.format('<t:task id="T"/><t:subProcess id="S"><t:userTask id="U" name="u"/></t:subProcess><t:scriptTask id="X"/>'), {("<T>", "a", "bbo:Task"), ("<T>", "org:belongsToProcess", "<P>"), ("<U>", "a", "bbo:UserTask"), ("<U>", "bbo:name", '"u"'), ("<U>", "org:belongsToProcess", "<P>"), ("<X>", "a", "bbo:ScriptTask")}),
    "two processes": ('<t:process id="P"><t:task id="T"/></t:process><t:process id="Q"/>', {("<T>", "org:belongsToProcess", "<P>"), ("<T>", "org:belongsToProcess", "<Q>")}),
    "events": (IN_PROCESS.format('<t:startEvent id="A"><t:outgoing>F1</t:outgoing></t:startEvent><t:boundaryEvent id="B" attachedToRef="T"><t:outgoing>F2</t:outgoing><t:errorEventDefinition id="ED"/></t:boundaryEvent><t:endEvent id="Z"/>'), {("<A>", "bbo:has_targetRef", "<F1>"), ("<B>", "a", "bbo:BoundaryEvent"), ("<ED>", "a", "bbo:ErrorEventDefinition"), ("<Z>", "a", "bbo:EndEvent")}),
    "flow with a condition": (IN_PROCESS.format('<t:sequenceFlow id="F" sourceRef="a" targetRef="b"><t:conditionExpression xsi:type="tFormal"> x &gt; 1 </t:conditionExpression></t:sequenceFlow>'), {("<F>", "a", "bbo:sequenceFlow"), ("<F>", "bbo:has_sourceRef", "<a>"), ("<F>", "bbo:has_targetRef", "<b>"), ("<F>", "bbo:condition", "<F/conditionExpression/1>"), ("<F/conditionExpression/1>", "bbo:xsi_type", '"tFormal"'), ("<F/conditionExpression/1>", "bbo:expression", '"x > 1"'), ("<F/conditionExpression/1>", "org:belongsToProcessSequenceFlow", "<F>")}),
    "choreography": (IN_CHOREOGRAPHY.format('<t:choreographyTask id="K" name="k" initiatingParticipantRef="p1"><t:incoming>i1</t:incoming><t:incoming>i2</t:incoming><t:participantRef>p1</t:participantRef></t:choreographyTask><t:participant id="p1" name="A"><t:participantMultiplicity id="M" minimum="0"/></t:participant>'), {("<C>", "org:belongsToDefinitions", "<D>"), ("<C>", "ext:isClosed", '"false"'), ("<K>", "org:belongsToChoreography", "<C>"), ("<K>", "ext:initiatingParticipantRef", '"p1"'), ("<K/incoming/2>", "org:belongsToChoreographyChoreographyTask", "<K>"), ("<K/participantRef/1>", "a", "ext:ParticipantRef"), ("<M>", "org:belongsToChoreographyParticipant", "<p1>"), ("<M>", "ext:minimum", '"0"')}),
    "annotations": ('<t:collaboration id="L"><t:textAnnotation id="A" signavio:alignment="left" textFormat="text/plain"><t:text>note</t:text></t:textAnnotation><t:association id="B" sourceRef="x" associationDirection="None"/></t:collaboration>', {("<L>", "a", "ext:Collaboration"), ("<A>", "ext:alignment", '"left"'), ("<A>", "ext:textFormat", '"text/plain"'), ("<A/text/1>", "org:belongsToCollaborationTextAnnotation", "<A>"), ("<B>", "org:belongsToCollaboration", "<L>"), ("<B>", "ext:associationDirection", '"None"'), ("<B>", "bbo:id", '"B"')}),
    "definitions": ('<t:category id="G"><t:categoryValue id="V" value="v"/></t:category><t:message id="W" name="w"/>', {("<D>", "a", "ext:Definitions"), ("<D>", "bbo:name", '"N"'), ("<D>", "ext:exporter", '"x"'), ("<D>", "ext:schemaLocation", '"l"'), ("<G>", "org:belongsToDefinitions", "<D>"), ("<V>", "org:belongsToCategory", "<G>"), ("<V>", "bbo:name", '"v"'), ("<W>", "a", "ext:Message")}),
    "timer and lanes": (IN_CHOREOGRAPHY.format('<t:startEvent id="A"><t:timerEventDefinition id="I"/></t:startEvent>') + IN_PROCESS.format('<t:laneSet id="LS"><t:lane id="LA" name="l"><t:flowNodeRef>T1</t:flowNodeRef><t:flowNodeRef>T2</t:flowNodeRef></t:lane></t:laneSet>'), {("<I>", "org:belongsToChoreographyStartEvent", "<A>"), ("<I>", "bbo:id", '"I"'), ("<LA>", "bbo:has_activity", "<T1>"), ("<LA>", "bbo:has_activity", "<T2>"), ("<LS>", "a", "ext:LaneSet")}),
}


@pytest.fixture(scope="module")
def mapped(spark, tmp_path_factory):
    """All cases as files of one folder, in one run; ids of different files are the same."""
    folder = tmp_path_factory.mktemp("models")
    for k, (inner, _) in enumerate(CASES.values()):
        (folder / f"m{k}.bpmn").write_text(document(inner))
    got = {}
    for r in mapping.map_files(spark, str(folder), base="urn:e:").collect():
        assert r["error"] is None
        row = (short(r["s"]), short(r["p"]), short(r["o"]))
        assert row not in got.setdefault(r["model"], set())
        got[r["model"]].add(row)
    return got


@pytest.mark.parametrize("case", list(CASES))
def test_cases(mapped, case):
    have = mapped[f"m{list(CASES).index(case)}"]
    assert CASES[case][1] <= have, CASES[case][1] - have


def test_absent_parts_give_nothing(mapped):
    rows = mapped[f"m{list(CASES).index('tasks')}"]
    assert not any(s == "<T>" and p == "bbo:name" for s, p, _ in rows)
    assert not any("{" in x or x.endswith("None>") for m in mapped.values() for row in m for x in row)


def test_rules_are_whole():
    """82 rules of different names and paths; what they refer to are rules, but for the one that the rule files leave open."""
    names = [r.name for r in RULES]
    assert len(names) == len(set(names)) == 82 and all(n.endswith("Mapping") or n == "ProcessManualTask" for n in names)
    asked = {v[1:].split(" ")[0] for r in RULES for _, v in r.values if v.startswith("^")}
    assert asked - set(names) <= {"ParticipantMapping", "ChoreographyTaskMapping"}
    for r in RULES:
        assert re.fullmatch(r"(//)?\w+(//?\w+)*", r.path) and r.kind.split(":")[0] in NAMESPACES
        assert all(p.split(":")[0] in NAMESPACES and (v[0] in "@<^" or v in ("text()", "type()")) for p, v in r.values)
        assert all(re.fullmatch(r"\^\w+ (all|parent|child)", v) for _, v in r.values if v[0] == "^")
