"""Golden metric values, twins, equality of relational and numeric plans, files, features and streams."""

import json
import math
import os

import numpy as np
import pytest

DATA_TABLES = ("events", "embeddings", "customer")
#: Metrics of the two toy segmentations.
GOLDEN = {
    "HitRate_3F": 0.5714285714285715, "HitRate_3P": 0.6666666666666666, "HitRate_3R": 0.5, "HitRate_w3F": 0.615058910162003,
    "HitRate_t3F": 0.0, "HitRate_t3P": 0.0, "HitRate_t3R": 0.0, "HitRate_wt3F": 0.0,
    "HitRate_0.5F": 0.28571428571428575, "HitRate_0.5P": 1 / 3, "HitRate_0.5R": 0.25, "HitRate_w0.5F": 0.307529455081001,
    "HitRate_t0.5F": 0.0, "HitRate_t0.5P": 0.0, "HitRate_t0.5R": 0.0, "HitRate_wt0.5F": 0.0,
    "DevE2R": 1.0, "DevR2E": 4.5, "DevtE2R": 8.0, "DevtR2E": 12.0,
    "Su": 0.76556390622295, "So": 0.90894734356069651, "Sf": 0.83111687541927404, "PWP": 0.80060422960725075, "PWR": 0.96363636363636362, "PWF": 0.87458745874587462,
}
SIDE = "track_id string, times array<double>, labels array<string>"


def test_golden_values(spark):
    from segmentry.operators import evaluation as E

    est = spark.createDataFrame([("x_1", [1.0, 4.0, 20.0], ["a", "b"]), ("y_2", [1.0, 4.0, 20.0], ["@", "b"])], SIDE)
    ref = spark.createDataFrame([("x_1", [3.0, 12.0, 20.0, 40.0], ["a", "b", "c"]), ("y_2", [3.0, 12.0, 20.0, 40.0], ["a", "b", "c"])], SIDE)
    got = {r["track_id"]: r.asDict() for r in E.evaluate(est, ref).collect()}
    for k, v in GOLDEN.items():
        assert abs(got["x_1"][k] - v) < 1e-6, k
    assert got["x_1"]["ds_name"] == "x" and 0 <= got["x_1"]["D"] <= 1
    assert got["y_2"]["PWF"] is None and got["y_2"]["Sf"] is None and abs(got["y_2"]["HitRate_3F"] - GOLDEN["HitRate_3F"]) < 1e-9


def names():
    from segmentry import queries, twins

    return sorted(twins.TWINS), sorted(queries.queries())


def same_rows(a, b):
    norm = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(repr([norm(x) for x in r]) for r in a) == sorted(repr([norm(x) for x in r]) for r in b)


@pytest.mark.parametrize("name", names()[0])
def test_twin(spark, sf, name):
    import duckdb

    from segmentry.queries import oracle_sql, queries

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in DATA_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries()[name](spark, sf)
    want = c.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert same_rows([tuple(r) for r in got.select(*[f"`{x}`" for x in columns]).collect()], want.fetchall())


@pytest.mark.parametrize("name", [n for n in names()[1] if n not in names()[0] and n not in ("factor_chnmf",)])
def test_other_query_runs(spark, sf, name):
    from segmentry.queries import queries

    assert queries()[name](spark, sf).count() > 0


def test_relational_and_numeric_plans_agree(spark, sf):
    from segmentry import queries as Q
    from segmentry.plans import registry as G
    from segmentry.plans import relational as R
    from segmentry.sources import frames as src

    p = src.events_packed(spark, sf).cache()
    rows = p.collect()
    for name, plan, config in (("foote", lambda: R.foote(p, **Q.FOOTE), {"M_gaussian": 16, "m_median": 4, "L_peaks": 8}), ("sf", lambda: R.sf(p, **Q.SF), {"M_gaussian": 7, "k_nearest": 0.1, "Mp_adaptive": 8}), ("cbm", lambda: R.cbm(p), {})):
        got = {r["track_id"]: list(r["bounds"]) for r in plan().select("track_id", "bounds").collect()}
        want = {r["track_id"]: list(map(int, G.ALGORITHMS[name].run(np.array(r["x"]), None, G.ALGORITHMS[name].defaults | config, 0)[0])) for r in rows}
        assert got == want, name


def test_every_pair_of_algorithms_keeps_the_invariants(spark, sf):
    from segmentry.plans import api
    from segmentry.plans import registry as G
    from segmentry.queries import seconds
    from segmentry.sources import frames as src

    p = seconds(src.events_packed(spark, sf)).limit(3).cache()
    short = p.selectExpr("track_id", "slice(ts, 1, 5) AS ts", "slice(x, 1, 5) AS x")
    last = {r["track_id"]: r["ts"][-1] for r in p.collect()}
    for b in G.algorithms("boundaries"):
        assert all((r["level"], r["seg"], r["start"], r["end"], r["label"]) == (0, 0, 0.0, 4.0, 0) for r in api.segment(short, b).collect())
        for l in [None, *G.algorithms("labels")]:  # noqa: E741
            own = {"niters": 30} if "cnmf" in (b, l) else {}
            by = {}
            for r in api.segment(p, b, l, **own).collect():
                by.setdefault(r["track_id"], []).append(r)
            assert by.keys() == last.keys()
            for t, rows in by.items():
                rows.sort(key=lambda r: r["seg"])
                assert rows[0]["start"] == 0 and rows[-1]["end"] == last[t]
                assert all(x["end"] == y["start"] for x, y in zip(rows, rows[1:])) and all(r["start"] < r["end"] for r in rows)
    for b in G.algorithms("hierarchical"):
        assert api.segment(p, b, hier=True).select("level").distinct().count() >= 1
    with pytest.raises(G.NoAlgorithmError):
        api.segment(p, "nothing")
    with pytest.raises(G.IncapableAlgorithmError):
        api.segment(p, "fmc2d")
    with pytest.raises(G.NoHierarchyError):
        api.segment(p, "sf", hier=True)


def test_convex_factorisation_is_not_cut_short(monkeypatch):
    from segmentry import queries as own
    from segmentry.plans import kernels as K
    from segmentry.plans import registry as G

    ranks = []

    def labels(x, rank, *rest):
        ranks.append(rank)
        return np.arange(len(x)) // 10 if rank >= 15 else np.zeros(len(x), int)

    defaults = G.ALGORITHMS["cnmf"].defaults
    assert K.cnmf(np.ones((40, 3)), None, defaults, 0)[0].tolist()[0] == 0
    monkeypatch.setattr(K, "frame_labels", labels)
    assert len(K.cnmf(np.ones((40, 3)), None, defaults, 0)[0]) == 5 and ranks == [*range(3, 16), 4]

    monkeypatch.setattr(own.api, "segment", lambda packed, b, l, hier, **params: G.configuration(b, l, **params))
    monkeypatch.setattr(own.src, "events_packed", lambda *a: None)
    monkeypatch.setattr(own, "seconds", lambda p: p)
    assert own.queries()["segment_cnmf"](None, "")["niters"] == defaults["niters"] == 500


def test_block_matching_finds_the_block_change(spark):
    from segmentry.plans import registry as G
    from segmentry.plans import relational as R

    x = [[1.0, 0.0]] * 8 + [[0.0, 1.0]] * 9
    assert list(G.ALGORITHMS["cbm"].run(np.array(x), None, G.ALGORITHMS["cbm"].defaults | {"ssm": "cosine"}, 0)[0]) == [0, 8, 16]
    df = spark.createDataFrame([("a", [float(k) for k in range(17)], x)], "track_id string, ts array<double>, x array<array<double>>")
    assert R.cbm(df, "cosine").first()["bounds"] == [0, 8, 16]


def test_small_fixtures(spark):
    from segmentry.functions import arrays as A
    from segmentry.operators import similarity as M

    df = spark.createDataFrame([([3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0], [[1.0, 2.0], [3.0, 4.0]])], "a array<double>, m array<array<double>>")
    r = df.select(A.median_filter("a", 4).alias("even"), A.median_filter("a", 3).alias("odd"), M.lag_matrix("m").alias("lag"), M.unlag_matrix(M.lag_matrix("m")).alias("back")).first()
    # windows of 4 reach two back; the upper of both middle values
    assert r["even"] == [3.0, 3.0, 3.0, 4.0, 5.0, 5.0, 5.0] and r["odd"] == [3.0, 3.0, 1.0, 4.0, 5.0, 5.0, 2.0]
    assert r["lag"] == [[1.0, 4.0], [3.0, 2.0]] and r["back"] == [[1.0, 2.0], [3.0, 4.0]]


def test_hierarchy_measure():
    from segmentry.plans import kernels as K

    levels = [np.array([0.0, 30.0]), np.array([0.0, 10.0, 20.0, 30.0])]
    assert K.t_measures(levels, levels, 10, 0.5) == (1.0, 1.0, 1.0)
    p, r, f = K.t_measures(levels, [np.array([0.0, 30.0]), np.array([0.0, 5.0, 30.0])], 10, 0.5)
    assert 0 < p < 1 and 0 < r < 1 and abs(f - 2 * p * r / (p + r)) < 1e-12


def test_exact_parts_of_factorisations():
    from itertools import combinations, product

    from segmentry.operators import factor as F

    rng = np.random.default_rng(3)
    basis, target = rng.random((7, 4)), rng.standard_normal((7, 40))
    best = np.full(40, np.inf)
    for rows in product([False, True], repeat=4):  # every set of rows that may be above zero
        h = np.zeros((4, 40))
        h[list(rows)] = np.linalg.lstsq(basis[:, list(rows)], target, rcond=None)[0]
        best = np.minimum(best, np.where((h >= 0).all(axis=0), np.linalg.norm(basis @ h - target, axis=0), np.inf))
    h = F.exact_nonnegative(basis, target)
    assert h.min() >= 0 and np.allclose(np.linalg.norm(basis @ h - target, axis=0), best)

    points = rng.standard_normal((60, 2))
    points = np.vstack([points, points[:10], [[0.0, 0.0]]])
    corners = points[F.hull_of(points)]
    edges = np.roll(corners, -1, axis=0) - corners
    assert min((e[0] * (points[:, 1] - c[1]) - e[1] * (points[:, 0] - c[0])).min() for e, c in zip(edges, corners)) > -1e-9
    assert F.hull_of(np.zeros((5, 2))) == [0]

    x = rng.random((5, 12))
    assert F.SIVM_SEARCH(x, 3).choose() == list(max(combinations(range(12), 3), key=lambda t: F.simplex_volume(x[:, list(t)])))

    x = np.concatenate([rng.normal([[5.0], [0.0]], 0.1, (2, 30)), [[0.0], [40.0]]], axis=1)
    assert F.GMAP(x, 1).choose() == [30] and F.GMAP(x, 1, kind="pca", robust=True).choose() != [30]  # a lone long column is passed over


@pytest.mark.parametrize("method", ["NMF", "SNMF", "CNMF", "RNMF", "NMFALS", "NMFNNLS", "PCA", "SVD", "CUR", "CMD", "CURSL", "GREEDY", "GREEDYCUR", "SIVM_CUR", "SUB", "AA", "CHNMF", "SIVM", "SIVM_SEARCH", "SIVM_SGREEDY", "SIVM_GSAT", "GMAP", "LAESA", "Kmeans", "Cmeans", "BNMF", "NNDSVD"])
def test_factorisation(method):
    from segmentry.operators import factor

    rng = np.random.default_rng(0)
    x = rng.random((8, 3)) @ rng.random((3, 40))
    m = factor.METHODS[method](x, 3).factorize(60)
    assert m.W.shape == (8, 3) and m.H.shape == (3, 40) and np.isfinite(m.errors).all()
    assert m.errors[-1] < 0.25 * np.linalg.norm(x)
    if method in ("AA", "SIVM", "LAESA", "GMAP", "CHNMF"):
        assert np.allclose(m.H.sum(axis=0), 1, atol=1e-6) and (m.H >= -1e-9).all()
    if method in ("NMF", "NMFALS", "CNMF"):
        assert (m.H >= 0).all() and all(b <= a + 1e-6 for a, b in zip(m.errors, m.errors[1:]))


def annotation(namespace, data, **sandbox):
    return {"namespace": namespace, "data": [{"time": t, "duration": d, "value": v, "confidence": None} for t, d, v in data], "sandbox": sandbox, "annotation_metadata": {"version": "", "annotator": {"name": "a"}}}


@pytest.fixture
def files(tmp_path):
    flat = [(0.0, 10.0, "A"), (10.0, 5.5, "@")]
    levels = [(0.0, 15.5, {"label": "A", "level": 0}), (0.0, 10.0, {"label": "A", "level": 1}), (10.0, 5.5, {"label": "B", "level": 1})]
    one = {"annotations": [annotation("segment_open", flat, boundaries_id="sf", labels_id=None, k_nearest=0.04, hier=False, bound_norm_feats="x"), annotation("segment_open", flat[:1], boundaries_id="sf", labels_id="fmc2d", k_nearest=0.04), annotation("multi_segment", levels, boundaries_id="olda", labels_id=None), annotation("segment_salami_lower", flat), annotation("segment_salami_upper", [(0.0, 15.5, "X")]), annotation("beat", [(1.068, 0.0, 1), (9.0, 0.0, 2)])], "file_metadata": {"duration": 15.5}, "sandbox": {}}
    (tmp_path / "ests").mkdir()
    (tmp_path / "ests" / "one.jams").write_text(json.dumps(one).replace('"x"', "Infinity"))
    (tmp_path / "ests" / "old.jams").write_text(json.dumps({"beats": [], "file_metadata": {"duration": 3}}))
    return str(tmp_path / "ests")


def test_annotation_files(spark, files):
    from segmentry.sources import annotations as ann

    a = ann.read_annotations(spark, files)
    assert a.count() == 6
    found = ann.find_estimations(a, "sf", None)
    assert [(r["track_id"], r["ann"], r["matches"]) for r in found.collect()] == [("one", 0, 1)]
    assert found.first()["sandbox"]["bound_norm_feats"] == "Infinity"
    assert ann.find_estimations(a, "sf", "fmc").count() == 0
    assert ann.find_estimations(a, "sf", "fmc", compat=True, k_nearest=0.04).first()["matches"] == 2
    assert ann.sides_of(found).first()["times"] == [0.0, 10.0, 15.5]
    assert ann.sides_of(found).first()["labels"] == ["A", "@"]
    got = {r["level"]: (r["times"], r["labels"]) for r in ann.estimation_levels(ann.find_estimations(a, "olda", hier=True)).collect()}
    assert got == {0: ([0.0, 15.5], ["A"]), 1: ([0.0, 10.0, 15.5], ["A", "B"])}
    assert [(r["level"], r["namespace"]) for r in ann.hierarchical_references(a).orderBy("level").collect()] == [(0, "segment_salami_upper"), (1, "segment_open"), (2, "segment_salami_lower")]
    assert ann.hierarchical_references(a, exclude=("segment_open",)).count() == 2
    assert ann.references(a, 3).first()["labels"] == ["X"]
    assert [r["frame_idx"] for r in ann.annotated_beats(a).orderBy("beat_idx").collect()] == [22, 193]


def test_small_files(spark, tmp_path):
    from segmentry.sources import annotations as ann

    (tmp_path / "s.lab").write_text("0.0\t5.0\t1\n5.0\t9.0\t2\n")
    assert [(r["track_id"], r["seg"], r["label"]) for r in ann.read_lab(spark, str(tmp_path / "s.lab")).collect()] == [("s", 0, "1"), ("s", 1, "2")]
    seg = spark.createDataFrame([("t", 0.0, 10.0, 0), ("t", 10.0, 20.0, 1), ("t", 20.0, 30.0, 2)], "track_id string, start double, end double, label int")
    assert ann.mirex_lines(seg).first()["text"] == "0.000\t10.000\t0\n10.000\t20.000\t1\n20.000\t30.000\t2"
    name = ann.results_name("a/b", None, 0, {f"key{k}": "v" * 20 for k in range(30)})
    assert len(name) == 255 and name.endswith(".csv") and "/" not in name
    path = str(tmp_path / "results")
    assert ann.cached_results(spark, path) is None
    ann.save_results(seg, path)
    assert ann.cached_results(spark, path).count() == 3
    audio = spark.createDataFrame([("/d/ds/audio/x_1.wav",)], "path string")
    assert ann.file_struct(audio).first().asDict() == {"track_id": "x_1", "ds_path": "/d/ds", "audio_path": "/d/ds/audio/x_1.wav", "est_path": "/d/ds/estimations/x_1.jams", "feat_path": "/d/ds/features/x_1.json", "ref_path": "/d/ds/references/x_1.jams"}
    m = spark.createDataFrame([({"b": "1", "a": "2"},)], "p map<string,string>")
    assert m.select(ann.params_key(m["p"])).first()[0] == "a=2;b=1"


def tone(path, seconds=6, rate=22050):
    import wave

    k = np.arange(seconds * rate)
    y = np.sin(2 * np.pi * 440 * k / rate) * (k % (rate // 2) < rate // 10)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((y * 30000).astype("<i2").tobytes())


def test_audio_features(spark, tmp_path):
    from segmentry.plans.registry import FeatureParamsError, FeatureTypeNotFound
    from segmentry.sources import annotations as ann
    from segmentry.sources import features as feat

    (tmp_path / "audio").mkdir()
    tone(tmp_path / "audio" / "t_1.wav")
    assert ann.dataset(spark, str(tmp_path)).first()["track_id"] == "t_1"
    audio = feat.audio_files(spark, str(tmp_path / "audio"))
    frames = feat.extract(audio).cache()
    sizes = {r["feature_id"]: r["n"] for r in frames.selectExpr("feature_id", "size(vec) AS n").distinct().collect()}
    assert sizes == {"cqt": 84, "mel": 80, "log_mel": 80, "mfcc": 14, "pcp": 12, "tonnetz": 6, "tempogram": 192}
    chroma = np.array([r["vec"] for r in feat.select(frames, "pcp", framesync=True).collect()])
    assert chroma.mean(axis=0).argmax() == 9
    assert 0 < feat.select(frames, "pcp").count() < len(chroma)
    with pytest.raises(FeatureParamsError):
        feat.select(frames, "pcp", annotated_beats=True, framesync=True)
    with pytest.raises(FeatureTypeNotFound):
        feat.select(frames, "nothing")
    out = str(tmp_path / "features")
    feat.write_features(frames, out)
    feat.write_features(frames.where("feature_id = 'pcp'"), out)
    assert spark.read.parquet(out).count() == frames.count()
    times = spark.createDataFrame([("t_1", [0.0, 3.0])], "track_id string, times array<double>")
    made = feat.sonify(audio, times).first()["content"]
    assert len(feat.decode_wav(bytes(made))) == 6 * 22050


def test_feature_file(spark, tmp_path):
    from segmentry.sources import features as feat

    one = {"globals": {"dur": 1.0, "sample_rate": 22050, "hop_length": 1024, "audio_file": "a.wav"}, "est_beatsync_times": [0.5, 0.9], "pcp": {"params": {"bins": "84"}, "framesync": [[1.0, 2.0], [3.0, 4.0]], "est_beatsync": [[1.0, 2.0], [3.0, 4.0]]}}
    (tmp_path / "a.json").write_text(json.dumps(one, indent=1))
    path = str(tmp_path / "a.json")
    assert [r["t"] for r in feat.read_feature_file(spark, path, "pcp").collect()] == [0.0, 1024 / 22050]
    assert [r["t"] for r in feat.read_feature_file(spark, path, "pcp", "est_beatsync", {"bins": 84}).collect()] == [0.5, 0.9]
    assert feat.read_feature_file(spark, path, "pcp", params={"bins": 12}).count() == 0
    assert feat.read_feature_file(spark, path, "pcp", rate=44100).count() == 0


def test_feature_cache(spark, tmp_path):
    from segmentry.plans.registry import FeatureTypeNotFound
    from segmentry.sources import annotations as ann
    from segmentry.sources import feature_cache as cache

    (tmp_path / "audio").mkdir()
    tone(tmp_path / "audio" / "t_1.wav")
    files, path = ann.dataset(spark, str(tmp_path)).cache(), tmp_path / "features" / "t_1.json"
    files.count()
    first = cache.cached_features(files, "pcp").collect()
    stored = json.loads(path.read_text())
    assert len(first) == len(stored["pcp"]["framesync"]) and set(stored) == {"globals", "est_beats", "est_beatsync_times", "pcp"}
    assert [r["t"] for r in cache.cached_features(files, "pcp", "est_beatsync").collect()] == stored["est_beatsync_times"]
    cache.cached_features(files, "tempogram", params={"win": 64}).collect()
    assert json.loads(path.read_text())["tempogram"]["params"] == {"win": "64"} and json.loads(path.read_text())["pcp"] == stored["pcp"]  # put beside
    assert len(cache.cached_features(files, "tempogram", params={"win": 32}).first()["vec"]) == 32
    assert "pcp" in json.loads(path.read_text())
    with pytest.raises(Exception, match="no annotated beats"):
        cache.cached_features(files, "pcp", "ann_beatsync").collect()
    with pytest.raises(FeatureTypeNotFound):
        cache.cached_features(files, "pcp", "nothing")
    assert abs(cache.read_durations(spark, str(path)).first()["dur"] - 6) < 0.01

    marked = files.selectExpr("*", "array(1.0D, 2.5D) AS ann_beats")
    synced = cache.cached_features(marked, "pcp", "ann_beatsync").collect()
    assert len(synced) == 3 and {"tempogram", "ann_beats"} < set(json.loads(path.read_text()))
    cache.cached_features(files.selectExpr("*", "array(2.0D) AS ann_beats"), "mfcc").collect()  # other beats, other rates: a new file
    assert set(json.loads(path.read_text())) == {"globals", "est_beats", "est_beatsync_times", "ann_beats", "ann_beatsync_times", "mfcc"}
    cache.cached_features(files, "pcp", rate=11025).collect()
    assert "mfcc" not in json.loads(path.read_text())
    path.write_text("{")
    assert cache.cached_features(files, "pcp").collect() == first  # a broken file is written anew
    os.remove(tmp_path / "audio" / "t_1.wav")
    assert cache.cached_features(files, "pcp").collect() == first  # the file serves without audio
    with pytest.raises(Exception, match="is absent"):
        cache.cached_features(files, "pcp", hop=512).collect()


def test_settings(spark):
    from segmentry.config import Settings

    assert Settings.of(spark).sample_rate == 22050
    assert Settings.of(spark, sample_rate="11025").sample_rate == 11025
    spark.conf.set("segmentry.hop_size", "512")
    assert Settings.of(spark).hop_size == 512
    spark.conf.unset("segmentry.hop_size")
    with pytest.raises(ValueError):
        Settings.of(spark, n_fft="many")
    with pytest.raises(KeyError):
        Settings.of(spark, nothing=1)
    assert Settings.parse("a=1,b='x,y',a=2") == {"a": "2", "b": "x,y"}


def test_joins(spark):
    from segmentry.operators import joins as J

    a = spark.createDataFrame([("t", 0, 0.0, 4.0), ("t", 1, 4.0, 9.0)], "track_id string, seg int, start double, end double")
    b = spark.createDataFrame([("t", 0, 0.0, 3.0), ("t", 1, 3.0, 5.0), ("t", 2, 5.0, 9.0)], "track_id string, seg int, start double, end double")
    assert sorted(tuple(r) for r in J.match_intervals(a, b).collect()) == [("t", 0, 0), ("t", 1, 2)]
    x = spark.createDataFrame([("t", 1.0), ("t", 7.0)], "track_id string, t double")
    y = spark.createDataFrame([("t", 0.0), ("t", 5.0)], "track_id string, t double")
    assert sorted(tuple(r) for r in J.nearest_points(x, y).collect()) == [("t", 1.0, 1.0), ("t", 7.0, 2.0)]
    p = spark.createDataFrame([("t", [0.0, 1.0], [[1.0], [2.0]]), ("u", [0.0], [[1.0]])], "track_id string, ts array<double>, x array<array<double>>")
    q = spark.createDataFrame([("t", [0.0, 1.0], [[3.0], [4.0]]), ("u", [0.5], [[1.0]])], "track_id string, ts array<double>, x array<array<double>>")
    assert [tuple(r) for r in J.zip_features(p, q).select("track_id", "x2").collect()] == [("t", [[3.0], [4.0]])]
    assert [r["track_id"] for r in J.unequal_axes(p, q).collect()] == ["u"]
    v = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "vec array<double>")
    assert {(r["i"], r["j"]): r["v"] for r in J.covariance(v).collect()} == {(0, 0): 2.0, (0, 1): 4.0, (1, 0): 4.0, (1, 1): 8.0}


def test_command_line(spark, sf, tmp_path):
    from segmentry.__main__ import main
    from segmentry.queries import annotated, seconds
    from segmentry.sources import frames as src

    p = src.events_packed(spark, sf)
    seconds(p).write.parquet(str(tmp_path / "in"))
    annotated(p).write.parquet(str(tmp_path / "ref"))
    main(["segment", str(tmp_path / "in"), str(tmp_path / "seg"), "--boundaries", "foote", "--labels", "fmc2d", "--param", "M_gaussian=16"])
    main(["evaluate", str(tmp_path / "seg"), str(tmp_path / "ref"), str(tmp_path / "out")])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 15


def test_transform_file(spark, tmp_path):
    from segmentry.plans import api

    np.save(tmp_path / "w.npy", np.arange(4.0).reshape(2, 2))
    assert api.load_transform(spark, str(tmp_path / "w.npy"), 2).tolist() == [[0.0, 1.0], [2.0, 3.0]]
    assert (api.load_transform(spark, None, 3) == np.eye(3)).all()


def test_own_algorithm(spark):
    from segmentry.plans import api
    from segmentry.plans import registry as G

    @G.algorithm("halves", boundaries=True, labels=False)
    def halves(x, bounds, c, seed):
        b = np.array([0, len(x) // 2, len(x) - 1])
        return b, np.full(2, -1)

    df = spark.createDataFrame([("a", [float(k) for k in range(21)], [[float(k)] for k in range(21)])], "track_id string, ts array<double>, x array<array<double>>")
    assert [(r["start"], r["end"]) for r in api.segment(df, "halves").orderBy("seg").collect()] == [(0.0, 10.0), (10.0, 20.0)]
    with pytest.raises(G.ParameterCollisionError):
        G.algorithm("other", boundaries=False, labels=True, M_gaussian=1)(halves)
        G.configuration("foote", "other")
    del G.ALGORITHMS["halves"], G.ALGORITHMS["other"]


def test_streams(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from segmentry.operators.factor import SIVM_GSAT, simplex_volume
    from segmentry.streaming import online

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = online.session_segments(stream).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    closed = {(r["user_id"], r["start"], r["n"]) for r in spark.table("sessions").collect()}
    batch = {(r["user_id"], r["start"], r["n"]) for r in events.groupBy("user_id", F.session_window("ts", "12 hours").alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n").collect()}
    assert closed and closed <= batch

    rng = np.random.default_rng(0)
    x = rng.random((40, 3))
    vectors = spark.createDataFrame([(k % 2, k, x[k].tolist()) for k in range(40)], "key long, vec_id long, vec array<double>")
    vectors.repartition(1).write.parquet(str(tmp_path / "vectors"))
    stream = spark.readStream.schema(vectors.schema).parquet(str(tmp_path / "vectors"))
    q = online.online_basis(stream).writeStream.format("memory").queryName("basis").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("basis").groupBy("key").agg(F.max_by("volume", "vec_id").alias("v")).collect()
    for r in last:
        own = x[r["key"] :: 2].T
        assert abs(r["v"] - simplex_volume(own[:, SIVM_GSAT(own, 3).choose()])) < 1e-9


def test_entry_without_the_subpackage(tmp_path, sf):
    """The rest imports and runs when the training-data subpackage is absent."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'foote_boundaries' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_sweep_and_mirex_commands(spark, sf, tmp_path):
    from segmentry.__main__ import main
    from segmentry.plans import api
    from segmentry.queries import annotated, seconds
    from segmentry.sources import frames as src

    p = src.events_packed(spark, sf)
    seconds(p).write.parquet(str(tmp_path / "in"))
    annotated(p).write.parquet(str(tmp_path / "ref"))
    main(["sweep", str(tmp_path / "in"), str(tmp_path / "ref"), str(tmp_path / "sweep"), "--boundaries", "foote", "--param", "M_gaussian=[16, 24]", "--param", "L_peaks=[8]", "--param", "m_median=[4]"])
    got = {json.loads(r["params"])["M_gaussian"]: r["HitRate_3F"] for r in spark.read.csv(str(tmp_path / "sweep"), header=True, inferSchema=True).select("params", "HitRate_3F").collect()}
    for size in (16, 24):
        one = api.evaluate(api.as_sides(api.segment(seconds(p), "foote", M_gaussian=size, L_peaks=8, m_median=4)), annotated(p))
        assert abs(one.agg({"HitRate_3F": "avg"}).first()[0] - got[size]) < 1e-9
    main(["mirex", str(tmp_path / "in"), str(tmp_path / "lines"), "--boundaries", "foote", "--labels", "fmc2d", "--param", "M_gaussian=16"])
    lines = spark.read.text(str(tmp_path / "lines")).collect()
    assert lines and all(len(r["value"].split("\t")) == 3 for r in lines)


def test_zero_rows_are_dropped(spark):
    from segmentry.operators.joins import drop_zero_rows

    rows = [("a", [0.0, 1.0, 2.0], [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]), ("b", [0.0], [[0.0, 0.0]])]
    got = drop_zero_rows(spark.createDataFrame(rows, "track_id string, ts array<double>, x array<array<double>>"))
    assert {r["track_id"]: (r["ts"], r["x"]) for r in got.collect()} == {"a": ([1.0], [[1.0, 0.0]]), "b": ([], [])}


def test_numbering_keeps_every_row(spark):
    """Coalesced ranges of one reading of the plan and not of the other lost rows of tables beyond a few thousand vectors."""
    from pyspark.sql import functions as F

    from segmentry.sources import frames as src

    own = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60000, 3).select(F.col("id").alias("vec_id"), F.array_repeat(F.col("id").cast("double"), 64).alias("vec"))
        got = src.numbered(rows, "vec_id")
        assert got.agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i"), F.sum((F.col("vec_id") != F.col("i") * 3).cast("int"))).first() == (20000, 20000, 0, 19999, 0)
        values = got.select("i", F.posexplode("vec").alias("d", "v"))
        assert values.agg(F.count("*"), F.countDistinct("i"), F.sum((F.col("v") != F.col("i") * 3).cast("int"))).first() == (64 * 20000, 20000, 0)
        some = spark.createDataFrame([(5, "b"), (None, "c"), (5, "a"), (1, "z")], "k long, v string")
        assert sorted((r["i"], r["v"]) for r in src.numbered(some, "k").collect()) == [(0, "z"), (1, "a"), (2, "b"), (3, "c")]
        assert src.numbered(some.where("k > 9"), "k").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_convex_weights_are_exact():
    """Gradient steps stopped short of the least distance and took most of the time."""
    from segmentry.operators import factor as F

    rng = np.random.default_rng(5)
    for k in (3, 20):
        basis = rng.random((7, k)) * np.logspace(0, -2, 7)[:, None]
        target = rng.random((7, 30))
        h = F.convex_weights(basis, target)
        slope = basis.T @ (basis @ h - target)
        # at the least distance no corner lies further down the slope than the point itself
        assert np.allclose(h.sum(axis=0), 1) and h.min() >= 0 and ((h * slope).sum(axis=0) - slope.min(axis=0)).max() < 1e-9
    same = np.repeat(rng.random((7, 1)), 3, axis=1)
    assert np.allclose(F.convex_weights(same, same[:, :1]).sum(axis=0), 1)


def test_convex_hull_factorisation_is_quick():
    """1.2 s for 5 sequences of 67 frames before."""
    from time import process_time

    from segmentry.operators import factor as F

    rng = np.random.default_rng(6)
    began = process_time()
    for _ in range(5):
        F.CHNMF(rng.random((7, 67)), 3).factorize(50)
    assert process_time() - began < 1


def test_corner_search_queues_no_whole_sets(monkeypatch):
    import heapq
    from itertools import combinations

    from segmentry.operators import factor as F

    pushed, push = [], heapq.heappush
    monkeypatch.setattr(heapq, "heappush", lambda q, v: (pushed.append(v), push(q, v)))
    rng = np.random.default_rng(7)
    for n, rank in ((30, 3), (12, 4), (9, 2), (9, 1)):
        pushed.clear()
        x = rng.random((6, n))
        got = F.SIVM_SEARCH(x, rank).choose()
        assert max((len(v[2]) for v in pushed), default=0) < max(rank, 2)
        if rank == 3:
            assert got == list(max(combinations(range(n), rank), key=lambda t: F.simplex_volume(x[:, list(t)])))


def test_greedy_corners_equal_one_by_one(monkeypatch):
    from segmentry.operators import factor as F

    x = np.random.default_rng(8).random((7, 40))
    d, out = F.pdist(x, x), [F.SIVM(x, 4).first()]
    for _ in range(3):
        out.append(max((k for k in range(40) if k not in out), key=lambda k: F.cayley_menger(d[np.ix_([*out, k], [*out, k])])))
    monkeypatch.setattr(F, "cayley_menger", None)  # candidates are measured together
    assert F.SIVM_SGREEDY(x, 4).choose() == out


def test_exchanged_corners_equal_one_by_one(monkeypatch):
    from segmentry.operators import factor as F

    x, out = np.random.default_rng(9).random((7, 40)), [0, 1, 2, 3]
    for k in range(4, 40):
        out = F.exchange(x, out, k)
    monkeypatch.setattr(F, "simplex_volume", None)  # distances are measured once
    assert F.SIVM_GSAT(x, 4).choose() == out


def test_hierarchy_measure_equals_brute_force():
    """Every sample was compared with its whole window, one by one: minutes for an hour of one sequence."""
    from time import process_time

    from segmentry.plans import kernels as K

    def depth(levels, i, j, step):
        return max([k for k, b in enumerate(levels, 1) if np.searchsorted(b, i * step + 1e-9, "right") == np.searchsorted(b, j * step + 1e-9, "right")], default=0)

    def plain(ref, est, n, window, step, transitive):
        shares = []
        for q in range(n):
            own = [(depth(ref, q, j, step), depth(est, q, j, step)) for j in range(max(0, q - window), min(n, q + window + 1)) if j != q]
            found = sorted({r for r, _ in own})
            both = [(a, b) for k, a in enumerate(found) for b in (found[k + 1 :] if transitive else found[k + 1 : k + 2])]
            pairs = [(e, f) for a, b in both for r, e in own for s, f in own if (r, s) == (a, b)]
            if pairs:
                shares.append(sum(e < f for e, f in pairs) / len(pairs))
        return float(np.mean(shares)) if shares else 0.0

    ref = [np.array([0.0, 12.0]), np.array([0.0, 5.0, 12.0]), np.array([0.0, 2.0, 5.0, 8.5, 12.0])]
    est = [np.array([0.0, 12.0]), np.array([0.0, 6.0, 12.0]), np.array([0.0, 4.0, 7.0, 9.0, 12.0])]
    n = 24
    for a, b in ((ref, est), (est, ref)):
        counts = K.depths_about(K.segment_numbers(a, n, 0.5), K.segment_numbers(b, n, 0.5), 9)
        for transitive in (False, True):
            assert abs(K.t_recall(counts, transitive) - plain(a, b, n, 9, 0.5, transitive)) < 1e-12
    long = [np.array([0.0, 900.0]), np.arange(0.0, 901.0, 30.0)]
    began = process_time()
    assert K.t_measures(long, long, 15) == (1.0, 1.0, 1.0) and process_time() - began < 1


def test_hierarchy_has_every_level():
    """At most 10 levels of a long sequence were made."""
    from segmentry.plans import kernels as K

    x = np.random.default_rng(1).random((200, 4))
    levels = K.olda(x, None, {"hier": True}, 0)
    assert [len(b) - 1 for b, _ in levels[1:-1]] == [*range(6, 21)][: len(levels) - 2] or len(levels) == 17
    assert len(levels) == 17 and len(K.N.adjacent_ward(x, 7)) == 7


def test_kmeans_leaves_finished_runs_alone():
    from segmentry.plans import numeric as N

    class Counted(np.ndarray):
        rows = 0

        def __rmatmul__(self, other):
            return np.asarray(other) @ np.asarray(self)

        def __matmul__(self, other):
            Counted.rows += len(other) if other.ndim == 3 else 0
            return np.asarray(self) @ other

        def __rmul__(self, other):
            return (np.asarray(self) * other).view(Counted)

    x = np.random.default_rng(2).random((60, 3))
    centres, labels = N.kmeans(x.view(Counted), 6, restarts=40, seed=1)
    assert np.allclose(centres, [x[labels == k].mean(axis=0) for k in range(6)])
    assert 40 < Counted.rows < 40 * 14  # as many for each run as it takes, not as many as the slowest takes


def test_oracle_reads_lists_of_distances():
    from segmentry.plans import kernels as K
    from segmentry.plans import numeric as N

    x = np.array([[0.0], [1.0], [2.0], [0.0], [1.0], [2.0], [5.0]])
    link, lrs = K.factor_oracle(N.euclidean(x, x).tolist(), 0.1)
    assert link == [-1, 0, 0, 0, 1, 2, 3, 0] and lrs == [0, 0, 0, 0, 1, 2, 3, 0]
    assert K.information_rate(lrs, [math.log2(i) for i in range(1, 8)]) > 0


#: Queries whose matrices are made in NumPy and leave it as rows; as expressions every cell took microseconds.
IN_NUMPY = ("recurrence_knn", "recurrence_mutual", "lag_matrix", "graph_degree", "balanced_affinity", "normalised_laplacian", "time_lag_median", "sf_boundaries_relational", "foote_boundaries_relational",)


@pytest.mark.parametrize("name", IN_NUMPY)
def test_matrices_are_made_in_numpy(spark, sf, name):
    from segmentry.queries import queries

    plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_long_track_equals_one_task(spark, sf, monkeypatch):
    """One task held several matrices of all pairs of frames, and failed on 10,256 of them."""
    from segmentry import queries as Q
    from segmentry.plans import long_track as L
    from segmentry.plans import matrices as T
    from segmentry.plans import numeric as N

    x = np.random.default_rng(0).random((300, 8)).cumsum(axis=0) % 1
    x[50:80], x[200:203] = x[10:40], x[0]
    x, n, k = N.normalise(x, "inf"), 297, 12
    monkeypatch.setattr(L, "CELLS", 3000)
    d = L.Distances(x, 3)
    top, last = (np.concatenate(v) for v in zip(*[L.limits(d, k, a, min(a + 100, n)) for a in range(0, n, 100)]))
    embedded = np.concatenate([x[i : n + i] for i in range(3)], axis=1)
    assert (L.linked(d, top, last, np.arange(n)) == N.recurrence(embedded, k, 1, T.distances(embedded)).astype(bool)).all()
    got = np.concatenate([L.curve(d, top, last, a, min(a + 100, n), 27) for a in range(0, n, 100)])
    assert np.allclose(got, T.structural_curve(embedded, k, 27), atol=1e-12)

    want = sorted(map(tuple, Q.queries()["embeddings_segmented"](spark, sf).collect()))
    monkeypatch.setattr(L, "ROWS", 100)
    monkeypatch.setattr(Q, "LONG", 100)
    plan = Q.queries()["embeddings_segmented"](spark, sf)
    assert sorted(map(tuple, plan.collect())) == want and len(want) > 2


#: Queries that return the error only: W and H of every frame are not made into rows.
ERRORS_ONLY = ("SIVM", "LAESA", "GMAP", "NMFNNLS", "NMFALS",)


@pytest.mark.parametrize("method", ERRORS_ONLY)
def test_errors_alone_equal_those_with_factors(spark, sf, method):
    from segmentry.operators import factor
    from segmentry.operators import sequences as S
    from segmentry.sources import frames as src

    p = S.min_max(src.events_packed(spark, sf))
    whole = factor.factorize_tracks(p, method).collect()
    alone = factor.factorize_tracks(p, method, factors=("error",)).collect()
    assert {r["factor"] for r in whole} == {"error", "W", "H"} and len(alone) == 15
    assert sorted((r["track_id"], r["v"]) for r in alone) == sorted((r["track_id"], r["v"]) for r in whole if r["factor"] == "error")
    assert len(whole) == 15 + 15 * 7 * 3 + 3 * 1000
