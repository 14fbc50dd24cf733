"""Three books of an invented parish, with families of its own."""

from __future__ import annotations

import json
from pathlib import Path

BIRTHS = [
    [
        {
            "cislo": "1", "datum_narozeni": "7.9.1861", "misto_dum": "Mlýnec č. 4", "dite_jmeno": "Tomáš", "dite_pohlavi": "chlapec", "dite_manzelske": "manželské",
            "otec_jmeno_stav": "Zeman Martin, krejčí v Mlýnci, syn Vojtěcha Zemana, chalupníka z Podolí, a Doroty roz. Kubátové", "otec_bydliste": "Mlýnec č. 4",
            "matka_jmeno_rodice": "Kateřina, dcera Jakuba Holuba, mlynáře z Podolí, a Barbory rozené Vondrákové",
            "kmotri": "Adam Vondrák, tesař z Podolí a Dorota Vondráková, jeho manželka", "babka": "Ludmila Kubátová",
        },
        {
            "cislo": "2", "datum_krtu": "24. listopadu 1863", "misto_dum": "Podolí č. 9", "dite_jmeno": "Alžběta", "dite_pohlavi": "děvče", "dite_manzelske": "nemanželské",
            "otec_jmeno_stav": "Holub Jiří, mlynář v Podolí, syn Jakuba Holuba a Barbory rozené Vondrákové",
            "matka_jmeno_rodice": "Terezie, dcera Adama Kubáta, tesaře z Mlýnce, a Ludmily rozené Čihákové", "kmotri": "Martin Zeman; Matouš Kubát", "babka": "",
        },
    ],
    [
        {
            "cislo": "3", "datum_narozeni": "2.2.1866", "misto_dum": "Mlýnec č. 21", "dite_jmeno": "Matouš", "dite_pohlavi": "chlapec", "dite_manzelske": "manželské",
            "otec_jmeno_stav": "Brdlansky Adam, truhlář v Mlýnci, syn Tomáše Brdlanskeho a Barbory roz. Tesařové", "matka_jmeno_rodice": "Dorota, dcera Matouše Kubáta, sedláka z Mlýnce",
            "kmotri": "Ludmila Brdlanská, výměnkářka z Mlýnce",
        },
    ],
]
MARRIAGES = [
    [
        {
            "cislo": "1", "misto_oddavek": "Mlýnec", "datum_oddavek": "11.5.1886", "zenich_jmeno_stav_rodice": "Zeman Tomáš, krejčí v Mlýnci, syn Martina Zemana, krejčího z Mlýnce, a Kateřiny roz. Holubové",
            "zenich_misto_prebyvani": "Mlýnec č. 4", "nevesta_jmeno_stav_rodice": "Holubová Alžběta, dcera Jiřího Holuba, mlynáře z Podolí, a Terezie rozené Kubátové",
            "nevesta_misto_zrozeni": "Podolí č. 9", "nevesta_datum_narozeni": "24.11.1863", "nevesta_stav": "svobodná", "svedkove": "Adam Vondrák, tesař z Podolí a Matouš Kubát, sedlák z Mlýnce",
        },
        {
            "cislo": "2", "misto_oddavek": "Mlýnec", "datum_ohlasek": "3.10.1892", "zenich_jmeno_stav_rodice": "Brdlanský Matouš, truhlář v Mlýnci, syn Adama Brdlanského, truhláře z Mlýnce, a Doroty roz. Kubátové",
            "nevesta_datum_narozeni": "1867", "nevesta_misto_narozeni": "Mlýnec č. 30", "nevesta_stav": "vdova", "svedkove": "",
        },
    ],
]
DEATHS = [
    [
        {"cislo": "1", "datum_umrti": "19.4.1898", "misto_dum": "Mlýnec č. 4", "zemrely_jmeno_stav": "Zeman Martin, výměnkář v Mlýnci, syn Vojtěcha Zemana a Doroty roz. Kubátové", "pohlavi": "muž", "vek": "63 let"},
        {"cislo": "4", "datum_umrti": "30.7.1899", "misto_dum": "Mlýnec č. 17", "zemrely_jmeno_stav": "Vondrák Jakub, nádeník v Mlýnci", "pohlavi": "muž", "vek": "48"},
    ],
]
BOOKS = {"Mlynec N [8101]": ("narozeni", BIRTHS), "Mlynec O [8102]": ("oddani", MARRIAGES), "Mlynec Z [8103]": ("umrti", DEATHS)}


def write(folder: Path) -> str:
    """The books as JSON lines, with side files; returns a glob."""
    for name, (typ, pages) in BOOKS.items():
        lines = [json.dumps({"file": f"{i + 1:04d}.png", "typ": typ, "folio": str(i + 1), "rok": "", "ok": True, "rows_count": len(rows), "rows": rows, "lint": {"ok": True, "empty_cells": 0, "issues": []}}, ensure_ascii=False) for i, rows in enumerate(pages)]
        (folder / f"{name}.jsonl").write_text("\n".join(lines) + "\n\n", encoding="utf-8")
    meta = folder / "books" / "Mlynec N [8101]"
    meta.mkdir(parents=True)
    (meta / "meta.json").write_text(json.dumps({"id": "8101", "name": "Mlynec N", "typ": "narozeni", "district": "Tábor", "localities": ["Mlýnec", "Podolí"], "source": "x"}), encoding="utf-8")
    return f"{folder}/*.jsonl"
