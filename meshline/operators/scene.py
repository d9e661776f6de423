"""Scenes from markup: the drawn primitives of SVG texts with what they inherit, and counts of elements.

A text is read by the standard library's parser, which takes both quotes, entities and white space as they come; names of
elements and attributes are in lower case. Texts that break off give what was read; null and empty ones give nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Layers by a group's class; the classes whose contents keep their size in the world; where text starts.
LAYERS = {
    "edges": "edges", "water": "water", "green": "water", "octi-grid": "grid", "transfers": "transfers", "stops": "stops", "imp-stop": "stops",
    "stations-dots": "stops", "stations": "stations", "imp-lbl": "stations", "imp-lbl-s": "stations",
}
WORLD, ALIGN = {"edges", "imp-stop"}, {"middle": "center", "end": "right"}
#: Numbers of each drawn element, by attribute, and the stroke width where none is given.
SHAPES = {"path": ((), 1.0), "circle": (("cx", "cy", "r"), 1.0), "rect": (("x", "y", "width", "height", "rx"), 0.0), "line": (("x1", "y1", "x2", "y2"), 1.0)}
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_LEADING, _SHIFT = re.compile(r"\s*(" + NUMBER + ")"), re.compile(rf"translate\(\s*({NUMBER})(?:[\s,]+({NUMBER}))?\s*\)")

PRIMITIVE = (
    "seq long, kind string, layer string, world_scale boolean, fill string, stroke string, stroke_width double, fill_rule string, opacity double, "
    "body string, align string, numbers map<string,double>"
)


def number(text: str | None, default: float = 0.0) -> float:
    """The number that a text begins with."""
    found = _LEADING.match(text or "")
    return float(found[1]) if found else default


def shift(transform: str | None) -> tuple[float, float]:
    found = _SHIFT.search(transform or "")
    return (float(found[1]), float(found[2] or 0)) if found else (0.0, 0.0)


class _Scene(HTMLParser):
    """Keeps the open groups; every drawn element becomes a row as it is met, a text when it ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.groups: list[tuple[list[str], tuple[float, float], dict]] = []
        self.rows: list[dict] = []
        self.label: dict | None = None
        self.said: list[str] = []

    def _given(self, attrs: dict, name: str, default: str | None) -> str | None:
        for held in (attrs, *(g[2] for g in reversed(self.groups))):
            if held.get(name) is not None:
                return held[name]
        return default

    def _row(self, kind: str, attrs: dict, **more) -> None:
        classes = [c for g in reversed(self.groups) for c in g[0]]
        layer = next((LAYERS[c] for c in classes if c in LAYERS), "other") if self.groups else "background"
        opacity = number(attrs["opacity"], 1.0) if attrs.get("opacity") is not None else None
        self.rows.append({"seq": len(self.rows), "kind": kind, "layer": layer, "world_scale": bool(WORLD & set(classes)), "opacity": opacity} | more)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attrs = {k: v or "" for k, v in attrs}
        if tag == "svg":
            box = [number(v) for v in (attrs.get("viewbox") or "").replace(",", " ").split()]
            size = box[2:] if len(box) == 4 else [number(attrs.get("width")), number(attrs.get("height"))]
            frame = [number(v) for v in (attrs.get("data-frame") or "").split()]
            numbers = dict(zip(("width", "height"), size, strict=True)) | (dict(zip(("frame_x", "frame_y", "frame_w", "frame_h"), frame, strict=True)) if len(frame) == 4 else {})
            self.rows.append({"seq": len(self.rows), "kind": "scene", "numbers": numbers})
        elif tag == "g":
            self.groups.append((attrs.get("class", "").split(), shift(attrs.get("transform")), attrs))
        elif tag == "text":
            self.label, self.said = attrs, []
        elif tag in SHAPES:
            names, width = SHAPES[tag]
            rule = self._given(attrs, "fill-rule", None)
            self._row(
                tag, attrs, fill=None if tag == "line" else self._given(attrs, "fill", "none"), stroke=self._given(attrs, "stroke", "none"),
                stroke_width=number(attrs.get("stroke-width"), width), fill_rule=rule if tag == "path" and rule in ("evenodd", "nonzero") else None,
                body=attrs.get("d", "") if tag == "path" else None, numbers={n: number(attrs.get(n)) for n in names},
            )

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in ("g", "text"):  # one that holds nothing is no group and no text
            self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if self.label is not None:
            self.said.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "g" and self.groups:
            self.groups.pop()
        elif tag == "text" and self.label is not None:
            a, self.label = self.label, None
            ax, ay = (sum(g[1][k] for g in self.groups) for k in (0, 1))
            numbers = {"x": number(a.get("x")), "y": number(a.get("y")), "ax": ax, "ay": ay, "font-size": number(a.get("font-size"), 12.0)}
            align = ALIGN.get(a.get("text-anchor", ""), "left")
            self._row("text", {}, fill=self._given(a, "fill", "#000"), body="".join(self.said), align=align, numbers=numbers)


def read(text: str) -> list[dict]:
    parser = _Scene()
    parser.feed(text)
    return parser.rows


def primitives(texts: DataFrame) -> DataFrame:
    """The primitives of each of ``texts(id, svg)`` in the order of the text: ``id`` and the columns of ``PRIMITIVE``.

    A ``scene`` row has the canvas's size and frame. Fill, stroke and fill rule come from the element or the nearest group
    that has them, the layer from the nearest group with a known class, places from all groups' translations.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = texts.sparkSession.createDataFrame([], f"id long, {PRIMITIVE}").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, svg in zip(batch.column("id").to_pylist(), batch.column("svg").to_pylist(), strict=True):
                rows = [{"id": i, **r, "numbers": list(r["numbers"].items())} for r in read(svg or "")]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=arrow)

    return texts.select("id", "svg").mapInArrow(run, schema)


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__()
        self.elements, self.attributes = Counter(), Counter()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.elements[tag] += 1
        self.attributes[tag] += len(attrs)


def element_counts(texts: DataFrame) -> DataFrame:
    """``tag``, ``elements``, ``attributes`` over all ``texts(text)``, counted within a batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, attributes = Counter(), Counter()
            for text in batch.column("text").to_pylist():
                parser = _Elements()
                parser.feed(text or "")
                elements += parser.elements
                attributes.update(parser.attributes)
            names = list(elements)
            yield pa.RecordBatch.from_pydict({"tag": names, "elements": [elements[n] for n in names], "attributes": [attributes[n] for n in names]},
                                             schema=pa.schema([("tag", pa.string()), ("elements", pa.int64()), ("attributes", pa.int64())]))

    counted = texts.select("text").mapInArrow(run, "tag string, elements long, attributes long")
    return counted.groupBy("tag").sum("elements", "attributes").toDF("tag", "elements", "attributes")
