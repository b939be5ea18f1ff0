"""Pending work by suffix, images by header, scripts by variant, descriptions put back."""

import struct

from pyspark.sql import functions as F

from folio.functions import scripts
from folio.operators import catalog
from folio.sources import images


def test_pending_by_suffix(spark):
    stems = spark.createDataFrame([("a",), ("b - c",), ("- b",), ("b",), ("1",), ("11",), ("z",), (None,)], "stem string")
    names = ["2024 - x - A.MP3", "x - b - c.mp3", "x - - b.mp3", "x - 11.mp3", "z.mp3", "x -z.mp3", None, "", " - ", "x - 11.mp3", "x - z.wav"]
    got = catalog.pending(stems, spark.createDataFrame([(n,) for n in names], "name string"))
    ends = [s for (s,) in stems.collect() if not any(s is not None and n and n.lower().endswith(f" - {s}.mp3") for n in names)]
    assert sorted(map(str, (r[0] for r in got.collect()))) == sorted(map(str, ends)) == ["1", "None", "z"]


def jpeg(w, h, *segments, frame=0xC2):
    out = b"\xff\xd8"
    for marker, data in segments:
        out += bytes([0xFF, marker]) + struct.pack(">H", 2 + len(data)) + data
    return out + bytes([0xFF, frame]) + struct.pack(">HBHH", 17, 8, h, w) + b"rest"


def png(w, h):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", w, h) + b"rest"


def test_pixels(spark):
    cases = {
        png(3, 70_000): ("image/png", 3, 70_000), png(0, 5): None, png(3, 4)[:18]: None,
        jpeg(640, 480, (0xE0, b"J" * 14), (0xC4, b"\xff\xc0" * 9), (0xDB, b"q" * 900)): ("image/jpeg", 640, 480), jpeg(1, 2, frame=0xC0): ("image/jpeg", 1, 2), jpeg(1, 2, frame=0xC8): None,
        jpeg(9, 9, *[(0xE2, b"icc")] * 300): ("image/jpeg", 9, 9), b"\xff\xd8\xff": None, b"\xff\xd8\x00\x00": None,
        b"GIF89a" + struct.pack("<HH", 300, 2): ("image/gif", 300, 2), b"RIFF____WEBPVP8X" + b"\0" * 8 + b"\x2b\x01\0\x0f\0\0": ("image/webp", 300, 16), b"%PDF-1.4": None, b"": None,
    }
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)] + [(99, None)], "id int, content binary")
    got = {r["id"]: r["p"] and tuple(r["p"]) for r in df.select("id", images.pixels(F.col("content")).alias("p")).collect()}
    assert got == dict(enumerate(cases.values())) | {99: None}


def test_choice_of_images(spark):
    rows = [("e", i, f"p{i}", bytearray(png(100 + i, 3000 if i == 2 else 50))) for i in range(9)] + [("e", 9, "p0", bytearray(png(1, 1))), ("e", -1, "broken", bytearray(b"x")), ("e", -2, "big", bytearray(png(5, 5) + b"x" * 999)), ("f", 0, "p0", bytearray(jpeg(2000, 1000)))]
    got = images.chosen(spark.createDataFrame(rows, "element string, n int, path string, content binary"), "element", ["n"], most_bytes=500)
    assert sorted(tuple(r) for r in got.collect()) == [("e", f"p{i}", "image/png", 100 + i if i != 2 else 53, 50 if i != 2 else int(3000 * (1568 / 3000)), i == 2) for i in range(5)] + [("f", "p0", "image/png", 1568, 784, True)]


def test_routing_goes_on_where_a_variant_fails(spark):
    def model(prompt, granted):
        if "bad" in prompt:
            raise ValueError
        return prompt.upper()

    def describer(elements):
        return {e.element_id: str(1 / len(e.caption)) for e in elements}

    prose = "prose " * 60
    figure = "\\begin{figure}\\caption{%s}\\end{figure}"
    rows = [(1, "llm", prose), (2, "llm", prose + "bad" + figure % "x"), (3, "llm", prose + "bad" + figure % ""), (4, "hybrid", prose + figure % "abcd"), (5, "hybrid", prose + figure % ""), (6, "regex", prose + "bad"), (7, "other", prose), (8, None, prose), (9, "llm", ""), (10, "hybrid", None)]
    got = {r["id"]: r for r in scripts.routed_scripts(spark.createDataFrame(rows, "id int, variant string, text string"), "id", "text", "variant", model, describer).collect()}
    assert {i: r["used"] for i, r in got.items()} == {1: "llm", 2: "hybrid", 3: "regex", 4: "hybrid", 5: "regex", 6: "regex", 7: "regex", 8: "regex", 9: None, 10: None}
    assert got[1]["script"] == prose.strip().upper() and got[2]["script"].endswith("1.0") and got[4]["script"].endswith("0.25") and got[6]["wanted"] == "regex" and got[9]["script"] is None


def test_descriptions_are_put_back_in_one_pass(spark):
    bodies = spark.createDataFrame([(1, "a HYBRID_ELEMENT_TABLE_001 b HYBRID_ELEMENT_DISPLAY_MATH_1002."), (2, "HYBRID_ELEMENT_FIGURE_001"), (3, "none"), (4, None)], "id int, body string")
    told = spark.createDataFrame([(1, "TABLE_001", "HYBRID_ELEMENT_TABLE_001 $1"), (1, "DISPLAY_MATH_1002", "m"), (1, "TABLE_001", "later"), (3, "FIGURE_001", "x"), (2, None, "y")], "id int, element_id string, told string")
    got = {r["id"]: r["body"] for r in scripts.reinserted(bodies, told, "id").collect()}
    assert got == {1: "a HYBRID_ELEMENT_TABLE_001 $1 b m.", 2: "", 3: "none", 4: None}
