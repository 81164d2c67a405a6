"""Models in XML: process trees (PTML) and nets (PNML). Process diagrams are in ``bpmn``."""

from __future__ import annotations

from xml.etree import ElementTree as E

from ..models.nets import Net
from ..models.trees import Node, Tree

#: fixed names of the PTML format
TAGS = {"xor": "xor", "sequence": "sequence", "and": "concurrent", "interleaved": "interleaved", "or": "or", "xorLoop": "loop"}
LEAVES = {"manualTask": "activity", "automaticTask": "tau"}


def read_ptml(text: str) -> Tree:
    """A tree in PTML. A loop has three children, body, redo and exit, and becomes the sequence of a loop and the exit."""
    root = E.fromstring(text)
    trees = root.findall("processTree")
    if root.tag != "ptml" or len(trees) != 1:
        raise ValueError("one ptml with one processTree is needed")
    tree = trees[0]
    kinds: dict[str, tuple[str, str | None]] = {}
    kids: dict[str, list[str]] = {}
    parent: dict[str, str] = {}
    for e in tree:
        if e.tag == "parentsNode":
            s, t = e.get("sourceId"), e.get("targetId")
            if t in parent:
                raise ValueError(f"node {t} has two parents")
            parent[t] = s
            kids.setdefault(s, []).append(t)
        elif e.tag in TAGS or e.tag in LEAVES:
            if (i := e.get("id")) is None or i in kinds:
                raise ValueError(f"node id {i!r}")
            kinds[i] = (e.tag, e.get("name"))
    seen: set[str] = set()

    def node(i: str) -> Node:
        if i not in kinds or i in seen:
            raise ValueError(f"node {i!r}")
        seen.add(i)
        tag, name = kinds[i]
        own = [node(c) for c in kids.get(i, [])]
        if tag in LEAVES:
            if own:
                raise ValueError("a leaf with children")
            return Node(LEAVES[tag], name if tag == "manualTask" else None)
        if not own:
            raise ValueError("an operator without children")
        if tag == "xorLoop":
            if len(own) != 3:
                raise ValueError("a loop needs three children")
            return Node("sequence", children=[Node("loop", children=own[:2]), own[2]])
        return Node(TAGS[tag], children=own)

    if tree.get("root") is None and not kinds:
        return Tree(None)
    out = Tree(node(tree.get("root")))
    if seen != set(kinds) or not set(parent) | set(parent.values()) <= seen:
        raise ValueError("a node or edge can't be reached from the root")
    return out


def write_ptml(tree: Tree) -> str:
    names = {v: k for k, v in (TAGS | LEAVES).items()}
    top = E.Element("ptml")
    body = E.SubElement(top, "processTree", {"root": "n0"} if tree.root else {})
    edges: list[tuple[str, str]] = []
    n = 0

    def node(x: Node, parent: str | None) -> None:
        nonlocal n
        own, n = f"n{n}", n + 1
        E.SubElement(body, names[x.kind], {"id": own} | ({"name": x.label} if x.label is not None else {}))
        if parent:
            edges.append((parent, own))
        kids = x.children
        if x.kind == "loop":  # body, one redo, and nothing at the exit
            redo = kids[1:] or [Node("tau")]
            kids = [kids[0], redo[0] if len(redo) == 1 else Node("xor", children=redo), Node("tau")]
        for c in kids:
            node(c, own)

    if tree.root:
        node(tree.root, None)
    for s, t in edges:
        E.SubElement(body, "parentsNode", {"sourceId": s, "targetId": t})
    return E.tostring(top, encoding="unicode")


def read_pnml(text: str) -> Net:
    """The first net of a PNML file; transitions without a name, or marked invisible, are silent.

    Deadlocks are a net's final markings here, so a declared final marking in which a transition can fire is an error.
    """
    root = E.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    net_ = root.find(".//net")
    own = [p for p in net_.iter("place") if p.get("id") is not None]
    places = {p.get("id"): i for i, p in enumerate(own)}
    net = Net(len(places), [int((p.findtext("initialMarking/text") or "0").strip()) for p in own])
    inputs: dict[str, list[int]] = {}
    outputs: dict[str, list[int]] = {}
    for a in net_.iter("arc"):
        s, t, k = a.get("source"), a.get("target"), int((a.findtext("inscription/text") or "1").strip())
        if s in places:
            inputs.setdefault(t, []).extend([places[s]] * k)
        else:
            outputs.setdefault(s, []).extend([places[t]] * k)
    for t in net_.iter("transition"):
        label = t.findtext("name/text")
        hidden = any(x.get("activity") == "$invisible$" for x in t.iter("toolspecific"))
        net.add(None if hidden or not label else label, inputs.get(t.get("id"), []), outputs.get(t.get("id"), []))
    for final in net_.iterfind("finalmarkings/marking"):
        marking = [0] * net.places
        for p in final.iterfind("place"):
            if p.get("idref") not in places:
                raise ValueError(f"a final marking of the unknown place {p.get('idref')!r}")
            marking[places[p.get("idref")]] += int((p.findtext("text") or "0").strip())
        if net.enabled(marking):
            raise ValueError(f"the final marking {marking} is no deadlock")
    return net


def write_pnml(net: Net) -> str:
    top = E.Element("pnml")
    page = E.SubElement(E.SubElement(top, "net", {"id": "net1", "type": "http://www.pnml.org/version-2009/grammar/pnmlcoremodel"}), "page", {"id": "page1"})
    for p in range(net.places):
        place = E.SubElement(page, "place", {"id": f"p{p}"})
        if net.marking and net.marking[p]:
            E.SubElement(E.SubElement(place, "initialMarking"), "text").text = str(net.marking[p])
    for i, t in enumerate(net.transitions):
        e = E.SubElement(page, "transition", {"id": f"t{i}"})
        if t.label is not None:
            E.SubElement(E.SubElement(e, "name"), "text").text = t.label
        for side, source in ((t.inputs, True), (t.outputs, False)):
            for p, k in sorted(side.items()):
                a = E.SubElement(page, "arc", {"id": f"a{i}{'i' if source else 'o'}{p}", "source": f"p{p}" if source else f"t{i}", "target": f"t{i}" if source else f"p{p}"})
                if k > 1:
                    E.SubElement(E.SubElement(a, "inscription"), "text").text = str(k)
    return E.tostring(top, encoding="unicode")
