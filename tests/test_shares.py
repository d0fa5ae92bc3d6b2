"""Building the index by shares: many small sorts instead of one per large bucket."""

import random
from collections import Counter, defaultdict
from pathlib import Path

from lexspark.operators import index, substrings
from lexspark.sources import segments, tables
from lexspark.sources.tables import Library


def corpus(criteria, n=60):
    rng = random.Random(5)
    text = lambda k: " ".join(rng.choices(["uno", "dos", "Ñandú", "x", "漢字", "7/2"], k=rng.randint(0, k)))
    rows = [{"id_tesis": str(i % (n - 3)), "rubro": text(5), "texto": text(40) if i % 7 else None, "tesis_codigo": f"T. {i}"} for i in range(n)]
    return criteria(rows)


def test_a_large_bucket_is_indexed_by_several_tasks(criteria, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SHARE", 500)
    df, root = corpus(criteria), tmp_path / "lib"
    made = Library.save(df, str(root), 2, pieces=True)
    for table in ("postings", "pieces"):
        # One file per task and task of one bucket only: the bucket is the number behind the last "_".
        files = [f.name.split(".")[0] for f in Path(root / table).glob("*.parquet")]
        assert len(files) > 4 and len({f.split("_")[-1] for f in files}) == 2
        assert len({f.split("-")[1] for f in files}) == len(files)
    names = ["id_tesis", "dl", "col", "tok", "pos"]
    assert Counter(map(str, made.postings.select(names).collect())) == Counter(map(str, index.postings(df).select(names).collect()))


def test_rows_of_postings_and_pieces(criteria):
    df = corpus(criteria)
    rows = df.collect()
    want, spelled = Counter(), Counter()
    for r in rows:
        for c in index.INDEXED:
            at = defaultdict(list)
            for n, t in enumerate((r[c] or "").lower().replace("ñ", "n").replace("ú", "u").replace("/", " ").split()):
                at[t].append(n)
            want.update((r.id_tesis, c, t, tuple(p)) for t, p in at.items())
        for c in substrings.COLUMNS:
            t = (r[c] or "").lower().replace("ñ", "n").replace("ú", "u") + "  "
            spelled.update({(r.id_tesis, c, t[i:i + 3]) for i in range(len(t) - 2)})
    assert Counter((r.id_tesis, r.col, r.tok, tuple(r.pos)) for r in index.postings(df).collect()
                   if r.col in ("rubro", "texto")) == Counter({k: n for k, n in want.items() if k[1] in ("rubro", "texto")})
    assert Counter(map(tuple, substrings.pieces(df).collect())) == spelled


def test_runs_of_few_letters(monkeypatch):
    texts = ["abcabc  ", "", "  ", "a😀b  ", "漢字  "]
    piece, text, held = substrings._cut(texts)
    got = sorted((held[p], int(t)) for p, t in zip(piece, text))
    assert got == sorted({(t[i:i + 3], n) for n, t in enumerate(texts) for i in range(len(t) - 2)})
    assert held == sorted(held)
    monkeypatch.setattr(substrings, "_CHUNK", 5)
    assert list(substrings._chunks([9, 2, 2, 2, 0, 7])) == [(0, 1), (1, 3), (3, 5), (5, 6)]
    assert list(substrings._chunks([])) == []


def test_a_large_bucket_of_segments_is_written_by_several_tasks(spark, criteria, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SHARE", 300)
    monkeypatch.setattr(segments, "TOKENS", 100)
    df = corpus(criteria).dropDuplicates(["id_tesis"]).localCheckpoint()
    made = segments.Segments.create(df, str(tmp_path / "segments"), 2)
    made.refresh(df.limit(0), df.select("id_tesis").limit(30))
    assert made.fold() == [0, 1]
    left = made.docs().select("id_tesis")
    want = index.postings(df.join(left, "id_tesis", "left_semi"))
    names = ["id_tesis", "dl", "col", "tok", "pos"]
    assert Counter(map(str, made.postings().select(names).collect())) == Counter(map(str, want.select(names).collect()))
    for version in (1, 3):
        for bucket in (0, 1):
            assert len(list(Path(tmp_path).glob(f"segments/postings/version={version}/*/bucket={bucket}/*.parquet"))) > 1


def test_impacts_of_a_large_bucket_are_sorted_by_several_tasks(spark, criteria, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TOKENS", 5)
    rows = [{"id_tesis": str(n), "rubro": "uno dos", "texto": f"uno w{n % 9}"} for n in range(400)]
    root = tmp_path / "lib"
    Library.save(criteria(rows), str(root), 2)
    made = Library.save_bounds(spark, str(root))
    files = [f.name.split(".")[0] for f in Path(root / "impacts").glob("*.parquet")]
    assert len(files) > 2 and len({f.split("-")[1] for f in files}) == len(files)
    assert sorted((r.id_tesis, r.tok, r.f_todo) for r in made.impacts.collect()) == sorted(
        (str(n), t, f) for n in range(400) for t, f in (("uno", 2), ("dos", 1), (f"w{n % 9}", 1)))
