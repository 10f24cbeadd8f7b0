"""Feature files of any layout, cut into chunks, against the same text read in one go."""

import json
import random
import time

import pytest

from waystone.sources import files as fi
from waystone.sources import scanning as sc

BLANK = "\ufeff\x1e \t\r"


def features(rng, n):
    out = []
    for k in range(n):
        kind = rng.choice(["Feature", "x", 'say "Feature"', "{[", "\\"])
        place = rng.choice([None, {"type": "Point", "coordinates": [1, 2]}])
        members = {"type": "Feature", "properties": {"n": str(k), "kind": kind}, "geometry": place}
        items = list(members.items())
        rng.shuffle(items)
        out.append(dict(items))
    return out


def document(rng, n):
    """A file in one of many layouts, sometimes damaged."""
    fs, indent = features(rng, n), rng.choice([None, None, 1])
    text = rng.choice([
        json.dumps({"type": "FeatureCollection", "crs": {"a": ["Feature"]}, "features": fs}, indent=indent),
        json.dumps({"features": fs, "type": "FeatureCollection", "z": [1, {"b": "Feature"}]}, indent=indent),
        "\n".join(map(json.dumps, fs)),
        json.dumps(fs, indent=indent),
        "\n".join(json.dumps({"features": [f], "type": "FeatureCollection"}) for f in fs),
        'stray words\nand "Feature" more\n' + "\n".join(map(json.dumps, fs)),
        "no JSON at all",
    ])
    for _ in range(rng.choice([0, 0, 1, 3])):
        i = rng.randrange(len(text) + 1)
        extra = rng.choice(['"', "{", "}", "[", "]", "\n", ",", '"Feature"', "\\", "x:"])
        text = rng.choice([text[:i] + text[i + 5 :], text[:i] + extra + text[i:], text[:i]])
    return text


def finished(kind, text):
    if kind == "object":
        return [text]
    parts = text.split(sc.MARK)[1:]
    if kind == "broken" and parts:
        return ['{"type":' + sc.MARK + x for x in parts]
    return [text] if text.strip(BLANK if kind == "stray" else None) else []


def read(scan, chunks):
    """Run the chunks one after the other, and put open texts together."""
    state, out, held = None, [], ""
    for k, chunk in enumerate(chunks):
        rows, state = scan(chunk, state, k == len(chunks) - 1)
        for kind, text, age in rows:
            if kind == "none":
                return [None]
            if kind in ("row", "early"):
                out.append(text)
            elif kind == "open":
                held = held + text if age else text
            elif kind != "nothing":
                out += finished(kind, held + text)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_cuts_change_nothing(seed):
    rng, scan = random.Random(seed), sc.scanner()
    for _ in range(300):
        parts = document(rng, rng.randint(0, 8)).split(sc.MARK)
        whole = sc.MARK.join(parts)
        chunks = parts[:1]
        for part in parts[1:]:
            if rng.random() < 0.5:
                chunks.append(sc.MARK + part)
            else:
                chunks[-1] += sc.MARK + part
        assert read(scan, chunks) == read(scan, [whole]), whole


@pytest.mark.parametrize("seed", range(3))
def test_objects_at_once_are_the_same_as_by_token(seed):
    """Same rows and same states, whatever the text is and wherever it is cut."""
    rng, fast, slow = random.Random(seed), sc.scanner(), sc.scanner(at_once=False)
    for _ in range(400):
        text, state = document(rng, rng.randint(0, 8)), None
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.choice([0, 1, 4])))
        chunks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        for k, chunk in enumerate(chunks):
            last = k == len(chunks) - 1
            got = fast(chunk, state, last)
            assert got == slow(chunk, state, last), text
            state = got[1]
    odd = ['{"a": 1\t,"b":"\t"}', "{} {}", '{"a":NaN}', '{"features": 5} {"x":[{"features":[{}]}]}', '{"features":[{"features":[1]}]}',
           '{"a":' + "9" * 5000 + "}", '{"a":' + "[" * 5000 + "]" * 5000 + "}", '{"a":1} {"b":2', "x {} y {", '{"\\u0066eatures":[{}]}']
    for text in odd:
        assert fast(text, None, False) == slow(text, None, False) and fast(text, None, True) == slow(text, None, True)


def test_sound_features_are_not_walked_token_by_token():
    turned = [{"geometry": {"type": "Point", "coordinates": [k, 1.5]}, "properties": {"kind": "Feature", "a": "x" * 9, "b": k},
               "type": "Feature"} for k in range(4000)]
    text, seconds = json.dumps({"type": "FeatureCollection", "features": turned}), []
    for scan in (sc.scanner(), sc.scanner(at_once=False)):
        began = time.perf_counter()
        out, _ = scan(text, None, True)
        seconds.append(time.perf_counter() - began)
        assert [json.loads(t) for kind, t, _ in out if kind == "row"] == turned
    assert seconds[0] * 2 < seconds[1]


def test_chunks_side_by_side(spark, tmp_path, monkeypatch):
    """Files in chunks of a few pieces and splits of a few hundred bytes; some chunks run from a
    wrong state first (the layout changes within a file, objects span several chunks)."""
    rng, texts = random.Random(7), {}
    for k in range(8):
        texts[f"f{k}"] = document(rng, rng.randint(0, 12))
    long = {"type": "x", "parts": [{"type": "Feature"}] * 99, "properties": {}, "geometry": {}}
    texts["long"] = "\n".join(map(json.dumps, [*features(rng, 5), long, *features(rng, 20)]))
    texts["mixed"] = "\n".join(map(json.dumps, features(rng, 20))) + "\n" + json.dumps(
        {"type": "FeatureCollection", "features": features(rng, 40)}, indent=1
    )
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rounds = []
    run = sc._run
    monkeypatch.setattr(sc, "_run", lambda *a: rounds.append(a[2]) or run(*a))
    monkeypatch.setattr(sc, "CHUNK_CHARS", 500)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = sc.scanned(fi.feature_pieces(spark.read, str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for r in sorted(found, key=lambda r: (r["_file"], r["chunk"], r["row"])):
        got.setdefault(r["_file"].rsplit("/", 1)[-1], []).append(r["text"])
    scan = sc.scanner()
    want = {name: read(scan, [text]) for name, text in texts.items() if text}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert len(rounds) > 2


def test_one_odd_file_uses_many_tasks(spark, tmp_path, monkeypatch):
    """No task has the whole of a file, and its name is not collected."""
    monkeypatch.setattr(sc, "CHUNK_CHARS", 4000)
    turned = [{"geometry": {"type": "Point", "coordinates": [k, 1]}, "properties": {"k": k, "pad": "x" * 150},
               "type": "Feature"} for k in range(3000)]
    path = tmp_path / "a-addresses-county.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": turned}))
    seen = []
    run = sc._run

    def counted(chunks, todo, turn):
        out = run(chunks, todo, turn)
        seen.append(out.filter("kind = 'end'").count())
        return out

    monkeypatch.setattr(sc, "_run", counted)
    made, rejects = fi.read_feature_files(spark, str(path))
    keys = [r["k"] for r in made.selectExpr(
        "try_variant_get(feature.properties, '$.k', 'int') as k", "source_order").orderBy("source_order").collect()]
    assert keys == list(range(3000)) and rejects.isEmpty()
    assert seen[0] == 1 and seen[1] > 100 and len(seen) == 2  # the guess was right for all chunks


def test_more_odd_files_than_are_listed(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    for k in range(6):
        (tmp_path / f"f{k}").write_text(document(rng, 6))
    plain = [{"type": "Feature", "properties": {"k": k}, "geometry": {"type": "Point", "coordinates": [k, 1]}} for k in range(9)]
    (tmp_path / "plain").write_text(json.dumps({"type": "FeatureCollection", "features": plain}))

    def rows():
        made, rejects = fi.read_feature_files(spark, str(tmp_path))
        shown = made.selectExpr("_file", "to_json(feature.properties) as p", "to_json(feature.geometry) as g")
        return sorted(map(str, shown.collect())), sorted(map(str, rejects.collect()))

    listed = rows()
    monkeypatch.setattr(fi, "LISTED", 0)
    assert rows() == listed
