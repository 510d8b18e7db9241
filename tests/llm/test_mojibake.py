import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm.mojibake import SPOIL, Model, find_garbled, fit, readings, restore_text, spoil, to_bytes, train, word_table

CLEAN = [
    "Die Größe des Puffers wird künftig überprüft, bevor die Übergabe beginnt.",
    "La vérification échoue dès que la valeur dépasse la limite précédente.",
    "Проверка завершается ошибкой, если очередь пуста после выпуска.",
    "Proszę usunąć zbędną gałąź po wdrożeniu, bo źródło się zmienia.",
    "Doğrulama başarısız oluyor, çünkü dosyanın değerleri boş görünüyor.",
    "この変更は二つに分けてください。検証は失敗します。",
    "검사가 실패합니다. 배포 이후 대기열이 늘어났습니다.",
    "A VERSÃO FICOU SÃ E SALVA © 2024, ÂGE « À VÉRIFIER » – 5 €",
    "├── src\n│   └── main → done ✅ 👩‍💻",
    "Total: 64 ms, about √47 ≈ 6.9 and Θ(n·log n)",
]
CHAINS = [c for c in SPOIL]


def spoilt(line, chain):
    return " ".join((spoil(w, chain) or w) if not w.isascii() else w for w in line.split(" "))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    clean = {k: "\n".join(rnd.sample(CLEAN, 3)) for k in range(1500)}
    bad, want = {}, {}
    n = 10_000
    for line in CLEAN[:7]:
        for chain in CHAINS:
            s = spoilt(line, chain)
            if s != line:
                whole = rnd.choice(CLEAN) + "\n" + s
                want[n], bad[n] = whole.replace(s, line), whole
                n += 1
    twice = spoilt(spoilt(CLEAN[0], ("utf-8", "cp1252")), ("utf-8", "cp1252"))
    want[n], bad[n] = CLEAN[0], twice
    return clean, bad, want


def test_found_and_restored(spark, texts):
    clean, bad, want = texts
    rows = [*clean.items(), *bad.items(), (-1, None), (-2, ""), (-3, "plain ascii"), (-4, "Gr��e")]
    out = restore_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    assert not any(got[k]["garbled"] for k in clean), [clean[k] for k in clean if got[k]["garbled"]][:2]
    assert all(got[k]["restored"] == v for k, v in clean.items())
    assert [got[-k]["garbled"] for k in (1, 2, 3, 4)] == [False, False, False, True]
    found = [k for k in bad if got[k]["garbled"]]
    assert len(found) >= 0.95 * len(bad), [bad[k] for k in bad if not got[k]["garbled"]]
    assert sum(got[k]["restored"] == want[k] for k in found) >= 0.9 * len(found)


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r[0] for r in find_garbled(df, "doc_id", "text").collect()}


FRENCH = "Cette modification concerne l’étape suivante du déploiement."


@pytest.mark.parametrize("encoding", ["cp1251", "mac_roman"])
def test_one_garbled_copy_spoils_no_clean_word(spark, texts, encoding):
    """A clean word that decodes as UTF-8 stands in one document of fifty, and a
    single document has it in another encoding."""
    clean, _, _ = texts
    rows = {k: v + "\n" + FRENCH if k % 50 == 0 else v for k, v in clean.items()}
    rows[-1] = FRENCH.encode("cp1252").decode(encoding)
    assert found(spark, [*rows.items()]) == {-1}


def test_false_finds_do_not_grow(spark, texts):
    clean, bad, _ = texts
    for copies in (1, 4):
        rows = [(k + 100_000 * c, v) for c in range(copies) for k, v in clean.items()] + [*bad.items()]
        got = found(spark, rows)
        assert not {k % 100_000 for k in got} & set(clean)
        assert len(got) >= 0.95 * len(bad)


def test_held_out_half(spark, texts):
    """The model of one half judges the other, whose words it may not know."""
    clean, bad, _ = texts
    rnd = random.Random(5)
    half = [(k, v) for k, v in clean.items() if k % 2] + [(k, v) for k, v in bad.items() if k % 2]
    half += [(20_000 + k, s) for k in range(5) for s in ("the user’s ‘own’ choice… at 2 × 4", "“see” «this» — or · that", "± 7 µm thé–bus")]
    model, margin = fit(spark.createDataFrame(half, "doc_id long, text string"), "text")
    model.known, model.complete = {}, False
    other = [v for k, v in clean.items() if not k % 2]
    assert not any(model.restore(other, margin)[0])
    lost = [v for k, v in bad.items() if not k % 2]
    assert sum(model.restore(lost, margin)[0]) >= 0.9 * len(lost)
    signs = ["window’s", "‘left’", "wait…", "A · B × 3", "± 5 µs", "café–bar", "“quoted” — and «so»"]
    assert not any(model.restore([" ".join(rnd.sample(signs, 3)) for _ in range(50)], margin)[0])


def test_model_is_exact_and_pruned_alike(spark):
    words = word_table(spark.createDataFrame([(1, "Größe Größe éa"), (2, "Größe")], "doc_id long, text string"), "text")
    model = train(words)
    n = {t: c for t, c in zip(("Grö", "röß"), model.tri(np.array([(ord(t[0]) << 42) | (ord(t[1]) << 21) | ord(t[2]) for t in ("Grö", "röß")], np.uint64))[0], strict=True)}
    assert all(abs(v - (1 + np.log(2))) < 2e-3 for v in n.values())
    small = train(words, size=3)
    assert len(small.tri.keys) <= 3 and isinstance(small, Model)
    assert np.isfinite(small.scores(["Größe", "xyz", "é"])).all()


def test_very_long_and_repeated_rows(spark):
    rows = [(1, "a" * 200_000 + "é"), (1, "x"), (1, "x"), (2, "vÃ©rifiÃ© " * 3)] + [(k, "vérifié é") for k in range(3, 60)]
    assert found(spark, rows) == {2}


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string").withColumns({"garbled": F.lit(1), "restored": F.lit(2), "id": F.lit(3)})
    assert restore_text(df, "doc_id", "text").count() == 0


def test_readings_go_back():
    for line in CLEAN[:7]:
        for w in line.split(" "):
            for chain in SPOIL:
                s = spoil(w, chain)
                if s and len(s) > len(w) and "utf-8" in chain:
                    assert w in readings(s).values(), (w, s, chain)
    assert to_bytes("\x9d”", "cp1252") == b"\x9d\x94"
    assert readings("plain") == {}
