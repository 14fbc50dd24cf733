"""Column templates of the record types."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from pathlib import Path

# key|label|group|required, in column order.
BIRTH = """
cislo|Číslo řádové||required
datum_narozeni|Rok, měsíc a den narození|datum
datum_krtu|Rok, měsíc a den křtu|datum
misto_dum|Místo (obec) a číslo domu
dite_jmeno|Jméno dítěte|dite
dite_pohlavi|Pohlaví (chlapec/děvče)|dite
dite_manzelske|Manželské / nemanželské|dite
nabozenstvi|Náboženství
otec_jmeno_stav|Otec: jméno, stav a povolání, jeho rodiče|otec
otec_bydliste|Otec: bydliště|otec
matka_jmeno_rodice|Matka: jméno, její rodiče (otec a jeho stav)|matka
matka_bydliste|Matka: bydliště, náboženství|matka
kmotri|Kmotři (svědci): jméno, stav a bydliště
babka|Porodní bába
krtitel|Pokřtil (kdo)
poznamenani|Poznamenání
"""
MARRIAGE = """
cislo|Číslo postupné||required
jmeno_oddavajiciho|Jméno oddávajícího
misto_oddavek|Místo oddávek
datum_ohlasek|Rok, měsíc a den – ohlášek|datum
datum_oddavek|Rok, měsíc a den – oddavek|datum
zenich_jmeno_stav_rodice|Ženich: jméno, stav a rodiče|zenich
zenich_misto_prebyvani|Ženich: místo přebývání, číslo domu|zenich
zenich_nabozenstvi|Ženich: náboženství (evang./katol.)|zenich
zenich_misto_narozeni|Ženich: místo zrození|zenich
zenich_datum_narozeni|Ženich: rok, měsíc a den narození|zenich
zenich_stav|Ženich: stav (svobodný/ovdovělý/rozvedený)|zenich
nevesta_jmeno_stav_rodice|Nevěsta: jméno, stav a rodiče|nevesta
nevesta_misto_prebyvani|Nevěsta: místo přebývání, číslo domu|nevesta
nevesta_nabozenstvi|Nevěsta: náboženství (evang./katol.)|nevesta
nevesta_misto_narozeni|Nevěsta: místo zrození|nevesta
nevesta_datum_narozeni|Nevěsta: rok, měsíc a den narození|nevesta
nevesta_stav|Nevěsta: stav (svobodná/ovdovělá/rozvedená)|nevesta
svedkove|Svědkové: jméno, stav a místo přebývání
poznamenani|Poznamenání
"""
DEATH = """
cislo|Číslo řádové||required
datum_umrti|Rok, měsíc a den úmrtí|datum
datum_pohrbu|Rok, měsíc a den pohřbu|datum
misto_dum|Místo (obec) a číslo domu
zemrely_jmeno_stav|Jméno zemřelého, stav a povolání|zemrely
pohlavi|Pohlaví (muž/žena)|zemrely
nabozenstvi|Náboženství|zemrely
vek|Stáří (věk)
pricina_smrti|Nemoc a příčina smrti
kdo_pohrbil|Pohřbil (kdo) / opatřen svátostmi
misto_pohrbu|Místo pohřbu
poznamenani|Poznamenání
"""
# Keys that a row of each type should have.
REQUIRED = {
    "narozeni": ("dite_jmeno", "otec_jmeno_stav", "matka_jmeno_rodice"),
    "oddani": ("zenich_jmeno_stav_rodice", "nevesta_jmeno_stav_rodice"),
    "umrti": ("zemrely_jmeno_stav", "datum_umrti"),
}
TYPES = ("narozeni", "oddani", "umrti")
COMBINED = "kombinovana"


@dataclass(frozen=True)
class ColumnSpec:
    key: str
    label: str
    group: str = ""
    required: bool = False


@dataclass(frozen=True)
class Template:
    typ: str
    columns: tuple[ColumnSpec, ...]

    @property
    def keys(self) -> list[str]:
        return [c.key for c in self.columns]

    @property
    def labels(self) -> list[str]:
        return [c.label.lower() for c in self.columns]


def _read(typ: str, text: str) -> Template:
    rows = [(line + "|||").split("|") for line in text.strip().splitlines()]
    return Template(typ, tuple(ColumnSpec(k, label, g, r == "required") for k, label, g, r, *_ in rows))


BUILT_IN = {t: _read(t, x) for t, x in zip(TYPES, (BIRTH, MARRIAGE, DEATH), strict=True)}


def combined(templates: dict[str, Template] | None = None) -> Template:
    """Columns of all types in order, the first of a key kept; ungrouped ones are grouped by their type."""
    seen = {"record_type": ColumnSpec("record_type", "Typ záznamu (narozeni/oddani/umrti)", "", True)}
    for t in TYPES:
        for c in (templates or BUILT_IN)[t].columns:
            seen.setdefault(c.key, replace(c, group=c.group or t))
    return Template(COMBINED, tuple(seen.values()))


def template(typ: str) -> Template:
    """The template of a type; ValueError if there is none."""
    if typ == COMBINED:
        return combined()
    if typ not in BUILT_IN:
        raise ValueError(f"no template for record type {typ!r}")
    return BUILT_IN[typ]


def load(path: str) -> Template:
    """A template from a JSON file {typ, columns: [{key, label, group, required}]}."""
    d = json.loads(Path(path).read_text(encoding="utf-8"))
    columns = tuple(ColumnSpec(c["key"], c.get("label", ""), c.get("group", ""), bool(c.get("required"))) for c in d.get("columns", []))
    if not columns:
        raise ValueError(f"no columns in {path}")
    return Template(d.get("typ", ""), columns)


def prompt(t: Template) -> str:
    """Instructions that list the columns of a template for a transcriber."""
    lines = [f'- "{c.key}": {c.label}' + (f" [{c.group}]" if c.group else "") for c in t.columns]
    return "\n".join([f"Record type: {t.typ}. Return a JSON object with folio, rok and rows; each row has these keys:", *lines])


def row_prompt(t: Template, side: str) -> str:
    """Instructions for one cut-out row of the left or right half of a double page."""
    if side not in ("left", "right"):
        raise ValueError(f"no side {side!r}")
    lines = [f'- "{c.key}": {c.label}' for c in t.columns]
    return "\n".join([f"One row of the {side} half of a double page. Record type: {t.typ}. Return one JSON object of short texts, empty where nothing is seen, with these keys:", *lines])
