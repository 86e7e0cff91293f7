"""Codes of law in XML: the place of every article."""

from passagemill.sources import codes as C

ART = '<n:EstructuraFuncional tipoParte="Artículo" idParte="{i}" derogado="{d}" fechaVersion="v{i}"><n:Metadatos><n:NombreParte>{n}</n:NombreParte></n:Metadatos><n:Texto> dice <b>{i}</b> </n:Texto></n:EstructuraFuncional>'


def article(i, n=None, d="no derogado"):
    return ART.format(i=i, n=i if n is None else n, d=d)


def part(kind, title, *inner, d="no derogado"):
    return f'<n:EstructuraFuncional tipoParte="{kind}" derogado="{d}"><n:EstructurasFuncionales>{"".join(inner)}</n:EstructurasFuncionales><n:Metadatos><n:TituloParte>{title}</n:TituloParte></n:Metadatos></n:EstructuraFuncional>'


def law(*inner):
    return f'<n:Norma xmlns:n="http://law.example/x"><n:EstructurasFuncionales>{"".join(inner)}</n:EstructurasFuncionales></n:Norma>'


WHOLE = law(
    part("Título", "Título\n  Preliminar", article(1), part("Párrafo", "Párrafo 1", article(2, d="derogado"))),
    part("Libro", "LIBRO SEXTO De todo", part("Título", "TITULO PRELIMINAR", article(3)), article(4, n=""), part("Título", "", part("Párrafo", "P", article(5))), d="derogado"),
    article(6),
    part("Título", "Título suelto", article(7)),
    part("Libro", "Libro XIV", article(8)),
    article(9),
)
WANT = [
    (0, "preliminar", ["Título Preliminar"], "1", False),
    (1, "preliminar", ["Título Preliminar", "Párrafo 1"], "2", True),
    (2, "vi", ["LIBRO SEXTO De todo", "TITULO PRELIMINAR"], "3", False),
    (3, "vi", ["LIBRO SEXTO De todo"], "?", False),
    (4, "vi", ["LIBRO SEXTO De todo", "P"], "5", False),
    (5, "final", [], "6", False),
    (6, "final", ["Título suelto"], "7", False),
    (7, "xiv", ["Libro XIV"], "8", False),
    (8, "final", [], "9", False),
]


def test_places_of_articles():
    rows = list(C.articles(WHOLE))
    assert [(r[0], r[1], r[4], r[5], r[7]) for r in rows] == WANT
    assert [r[8] for r in rows] == [str(i) for i in range(1, 10)] and rows[0][6] == "v1" and rows[0][9].split() == ["dice", "1"]
    assert [r[3] for r in rows] == [False, False, True, True, True, False, False, False, False]


def test_book_keys():
    assert [C.book_key(x) for x in ("LIBRO CUARTO: DE", "Libro iv", "Título preliminar", "Anexo de cosas varias", "")] == ["iv", "iv", "preliminar", "anexo de cos", ""]


def test_deep_files_and_broken_ones(spark, tmp_path):
    deep = law("".join(f'<n:EstructuraFuncional tipoParte="Título"><n:Metadatos><n:TituloParte>T{k}</n:TituloParte></n:Metadatos><n:EstructurasFuncionales>' for k in range(300)) + article(1) + "</n:EstructurasFuncionales></n:EstructuraFuncional>" * 300)
    assert list(C.articles(deep))[0][4] == [f"T{k}" for k in range(300)]
    files = spark.createDataFrame([(1, WHOLE, "a"), (2, None, "b"), (3, "", "c"), (4, WHOLE[:-20], "d"), (5, law(), "e")], "id int, xml string, other string")
    found = C.articles_of(files).orderBy("id", "at").collect()
    assert [(r["at"], r["book"], list(r["path"]), r["number"], r["repealed"]) for r in found] == WANT and {(r["id"], r["other"]) for r in found} == {(1, "a")}
    (tmp_path / "b").mkdir()
    (tmp_path / "a.xml").write_text(WHOLE)
    (tmp_path / "b" / "c.xml").write_text(WHOLE)
    (tmp_path / "d.txt").write_text(WHOLE)
    assert C.read_codes(spark, str(tmp_path)).groupBy("file").count().count() == 2


def test_small_files_share_a_batch(monkeypatch):
    import pyarrow as pa

    one = '<N><EstructurasFuncionales><EstructuraFuncional tipoParte="Artículo" idParte="p%d"><!-- x --><Texto>t</Texto></EstructuraFuncional></EstructurasFuncionales></N>'
    files = [one % k * (k % 5 != 3) for k in range(40)]  # every fifth is empty
    batch = pa.record_batch([pa.array(range(40)), pa.array(files)], names=["law", "xml"])
    want = [(k, *row) for k, x in enumerate(files) for row in C.articles(x)]
    for most, n in ((C.MOST_ARTICLES, 1), (8, 4)):
        monkeypatch.setattr(C, "MOST_ARTICLES", most)
        made = list(C.walker(["law"])(iter([batch])))
        assert len(made) == n and [tuple(r.values()) for b in made for r in b.to_pylist()] == want and len(want) == 32
