"""Scenes from markup: inheritance, layers and text, by known cases."""

from meshline.operators import scene as S


def test_leaves_inherit_from_the_nearest_group():
    got = S.read(
        '<svg width="30" height="20" data-frame="1 2 3 4"><rect width="30" height="20" fill="#eee"/><g class="water" fill="#08f" fill-rule="evenodd"><path d="M0,0Z"/>'
        '<g class="green" fill="#0a0"><path d="M1,1Z" fill-rule="odd"/></g></g><g class=\'edges\' stroke = "red"><path d="M2,2" stroke-width="2.5" opacity=".5"/><line x2="4"/></g><g/><circle r="3"/></svg>'
    )
    assert got[0]["numbers"] == {"width": 30, "height": 20, "frame_x": 1, "frame_y": 2, "frame_w": 3, "frame_h": 4}
    told = [(r["kind"], r["layer"], r["world_scale"], r["fill"], r["stroke"], r["fill_rule"], r["stroke_width"], r["opacity"]) for r in got[1:]]
    assert told == [
        ("rect", "background", False, "#eee", "none", None, 0, None), ("path", "water", False, "#08f", "none", "evenodd", 1, None), ("path", "water", False, "#0a0", "none", None, 1, None),
        ("path", "edges", True, "none", "red", None, 2.5, 0.5), ("line", "edges", True, None, "red", None, 1, None), ("circle", "background", False, "none", "none", None, 1, None),
    ]


def test_text_takes_all_translations_and_entities():
    got = S.read(
        '<svg viewBox="0,0 10 5"><g class="stations" transform="translate(1.5e1, -2)"><g class="imp-lbl-s" transform="scale(2) translate(3)"><text x="1" font-size="9" text-anchor="middle">A &amp;amp; '
        '<tspan>&#233;</tspan>&quot;</text></g></g><text y="4">Empty</text><text/></svg>'
    )
    label, empty = got[1:]
    assert got[0]["numbers"] == {"width": 10, "height": 5}
    assert (label["body"], label["align"], label["layer"], label["fill"]) == ('A &amp; é"', "center", "stations", "#000")
    assert label["numbers"] == {"x": 1, "y": 0, "ax": 18, "ay": -2, "font-size": 9}
    assert (empty["body"], empty["align"], empty["layer"], empty["numbers"]["y"]) == ("Empty", "left", "background", 4)


def test_broken_null_and_empty_texts(spark):
    rows = [(1, None), (2, ""), (3, '<svg><g class="stops"><circle cx="1'), (4, "</g></text><g><circle cx='7px'/>"), (5, "no markup < at > all")]
    got = S.primitives(spark.createDataFrame(rows, "id long, svg string")).collect()
    assert [(r.id, r.kind, r.numbers.get("cx")) for r in got] == [(3, "scene", None), (4, "circle", 7.0)]
