"""Word lists of the register language, and the tables made of them."""

from __future__ import annotations

# Spellings of given names, by the canonical one.
GIVEN_VARIANTS: dict[str, tuple[str, ...]] = {
    "jan": ("johann", "joannes", "johannes", "hans"),
    "josef": ("joseph", "josephus", "jozef"),
    "frantisek": ("franz", "franciscus"),
    "vaclav": ("wenzel", "wenceslaus"),
    "antonin": ("anton", "antonius"),
    "karel": ("karl", "carolus"),
    "jakub": ("jakob", "jacobus"),
    "matej": ("mathias", "matthias"),
    "tomas": ("thomas",),
    "jiri": ("georg", "georgius"),
    "petr": ("peter", "petrus"),
    "pavel": ("paul", "paulus"),
    "martin": ("martinus",),
    "vojtech": ("adalbert", "adalbertus"),
    "ondrej": ("andreas",),
    "vit": ("vitus",),
    "vavrinec": ("laurenz", "laurentius"),
    "stepan": ("stephan", "stephanus"),
    "ignac": ("ignaz", "ignatius"),
    "alois": ("aloisius",),
    "bohumil": ("gottlieb",),
    "jindrich": ("heinrich", "henricus"),
    "bedrich": ("friedrich",),
    "vilem": ("wilhelm",),
    "ludvik": ("ludwig", "ludovicus"),
    "marie": ("maria", "mari"),
    "anna": ("anny", "anne"),
    "katerina": ("katharina", "catharina", "kateriny"),
    "barbora": ("barbara", "barbory"),
    "alzbeta": ("elisabeth", "elisabetha", "alzbety"),
    "frantiska": ("franziska", "frantisky"),
    "josefa": ("josefy", "josepha"),
    "terezie": ("theresia", "tereza", "terezy"),
    "antonie": ("antonia", "antonii"),
    "veronika": ("veroniky",),
    "ruzena": ("rosalia", "ruzeny"),
    "magdalena": ("magdaleny", "magdalina"),
    "dorota": ("dorothea", "doroty"),
    "ludmila": ("ludmily",),
    "zofie": ("sophia", "zofia", "zofii"),
    "karolina": ("karoliny",),
    "kristyna": ("christina", "kristiny"),
    "apolena": ("apolonia", "apoleny"),
    "oldrich": ("ulrich", "udalricus", "voldrich"),
}
# Canonical given names of women.
FEMALE = frozenset(
    "marie anna katerina barbora alzbeta frantiska josefa terezie antonie veronika ruzena magdalena dorota ludmila zofie karolina kristyna apolena eleonora johana".split()
)
# Genitives of men's given names.
MALE_GENITIVE: dict[str, str] = {
    "josefa": "josef", "jana": "jan", "vaclava": "vaclav", "frantiska": "frantisek", "antonina": "antonin",
    "karla": "karel", "jakuba": "jakub", "mateje": "matej", "tomase": "tomas", "jiriho": "jiri", "petra": "petr",
    "pavla": "pavel", "martina": "martin", "vojtecha": "vojtech", "ondreje": "ondrej", "vita": "vit",
    "vavrince": "vavrinec", "stepana": "stepan", "ignace": "ignac", "aloise": "alois", "rudolfa": "rudolf",
    "emanuela": "emanuel", "bohumila": "bohumil", "jindricha": "jindrich", "bedricha": "bedrich",
    "vilema": "vilem", "ludvika": "ludvik", "oldricha": "oldrich",
}
# How canonical given names are written.
WRITTEN: dict[str, str] = {
    "jan": "Jan", "josef": "Josef", "frantisek": "František", "vaclav": "Václav", "antonin": "Antonín",
    "karel": "Karel", "jakub": "Jakub", "matej": "Matěj", "tomas": "Tomáš", "jiri": "Jiří", "petr": "Petr",
    "pavel": "Pavel", "martin": "Martin", "vojtech": "Vojtěch", "ondrej": "Ondřej", "vit": "Vít",
    "vavrinec": "Vavřinec", "stepan": "Štěpán", "ignac": "Ignác", "alois": "Alois", "rudolf": "Rudolf",
    "emanuel": "Emanuel", "bohumil": "Bohumil", "jindrich": "Jindřich", "bedrich": "Bedřich",
    "vilem": "Vilém", "ludvik": "Ludvík", "oldrich": "Oldřich", "marie": "Marie", "anna": "Anna",
    "katerina": "Kateřina", "barbora": "Barbora", "alzbeta": "Alžběta", "frantiska": "Františka",
    "josefa": "Josefa", "terezie": "Terezie", "antonie": "Antonie", "veronika": "Veronika",
    "ruzena": "Růžena", "magdalena": "Magdalena", "dorota": "Dorota", "ludmila": "Ludmila",
    "zofie": "Žofie", "karolina": "Karolína", "kristyna": "Kristýna", "apolena": "Apolena",
}
# Month words, folded, by month.
# fixed values: short names of the months, from 1
MONTH_LABELS = ("", "led", "úno", "bře", "dub", "kvě", "čvn", "čvc", "srp", "zář", "říj", "lis", "pro")
MONTHS: dict[int, str] = {
    1: "leden ledna januar janner januarius januarii",
    2: "unor unora februar februarius februarii",
    3: "brezen brezna marz martius martii",
    4: "duben dubna april aprilis",
    5: "kveten kvetna mai maius maji",
    6: "cerven cervna juni junius",
    7: "cervenec cervence juli julius",
    8: "srpen srpna august augustus",
    9: "zari september septembris",
    10: "rijen rijna oktober octobris",
    11: "listopad listopadu november novembris",
    12: "prosinec prosince dezember decembris",
}
# Stems of trades.
TRADES = tuple(
    """rolnik domkar chalupnik sedlak havir hornik delnik mistr obuvnik krejci kovar truhlar zednik ucitel
    svec mlynar reznik pekar tkadlec tesar nadenik hostinsky obchodnik kupec baracnik vymenkar celedin devecka
    tovarys hutnik slevac strojnik zamecnik kocijas slouha ovcak hajny soused mestan gruntovnik zahradnik
    familiant podruh vojin vojak cetnik listonos zeleznicni topic strojvedouci sladek bednar kolar sklenar""".split()
)
# Words for the marital status, and the status.
STATUS: dict[str, str] = {
    "svobodny": "svobodny", "svobodna": "svobodna", "vdovec": "vdovec", "vdova": "vdova", "ovdovela": "vdova",
    "ovdovely": "vdovec", "rozvedeny": "rozvedeny", "rozvedena": "rozvedena", "manzelsky": "manzelsky",
    "nemanzelsky": "nemanzelsky", "manzelske": "manzelsky", "nemanzelske": "nemanzelsky",
    "manzelska": "manzelsky", "nemanzelska": "nemanzelsky",
}
# Letters that folding replaces, and by what.
FOLD_FROM = "áäàâčçďéěëèíïìňóöôřšťúůüùýÿž"
FOLD_TO = "aaaaccdeeeeiiinooorstuuuuyyz"

CANONICAL: dict[str, str] = {v: c for c, vs in GIVEN_VARIANTS.items() for v in (*vs, c)}
GIVEN_SEX: dict[str, str] = {c: "f" if c in FEMALE else "m" for c in GIVEN_VARIANTS}
MONTH_OF: dict[str, int] = {w: m for m, ws in MONTHS.items() for w in ws.split()}
#: The longest word first, so that a word that holds another wins whatever the order above.
STATUS_WORDS = tuple(sorted(STATUS, key=lambda w: (-len(w), w)))
PLACE_WORDS = ("v", "ve", "z", "ze", "na")
