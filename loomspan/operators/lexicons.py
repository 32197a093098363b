"""Word tables for perturbation, a small set of common words for each of six languages.

Callers may give tables of their own: rows (``lang``, ``word``, ``way``, ``put``) with a word in lower case, what it is for,
and what takes its place.
"""

from __future__ import annotations

#: Opposites serve both ways.
OPPOSITES = {
    "en": "warm cool, wide narrow, rich poor, heavy light, deep shallow, full empty, easy difficult, cheap expensive, near far, north south, inside outside, many few, more less, always never, before after, with without, increase decrease, high low, open closed, win lose, buy sell, arrive leave, remember forget, allow forbid, true false, public private, ancient modern",
    "de": "warm kühl, breit schmal, reich arm, schwer leicht, tief flach, voll leer, einfach schwierig, billig teuer, nah fern, mehr weniger, immer nie, vor nach, mit ohne, hoch niedrig, innen außen, viele wenige, kaufen verkaufen, kommen gehen, erlauben verbieten, wahr falsch, öffentlich privat, alt modern",
    "es": "ancho estrecho, rico pobre, pesado ligero, lleno vacío, fácil difícil, barato caro, cerca lejos, más menos, siempre nunca, antes después, con sin, alto bajo, dentro fuera, muchos pocos, comprar vender, llegar salir, permitir prohibir, verdadero falso, público privado, antiguo moderno",
    "fr": "large étroit, riche pauvre, lourd léger, plein vide, facile difficile, proche lointain, plus moins, toujours jamais, avant après, avec sans, haut bas, dedans dehors, beaucoup peu, acheter vendre, arriver partir, permettre interdire, vrai faux, public privé, ancien moderne",
    "ru": "широкий узкий, богатый бедный, тяжёлый лёгкий, полный пустой, простой сложный, дешёвый дорогой, близко далеко, больше меньше, всегда никогда, внутри снаружи, много мало, купить продать, прийти уйти, разрешить запретить, верный ложный, древний современный",
    "zh": "增加 减少, 提高 降低, 成功 失败, 安全 危险, 简单 复杂, 允许 禁止, 公开 秘密, 古代 现代, 支持 反对, 开始 结束",
}
#: Words of a weak claim and what makes it a firm one, never the other way round.
HEDGES = {
    "en": "may will, might will, could can, should shall, perhaps definitely, maybe definitely, apparently evidently, supposedly actually, seldom never, sometimes always, usually always, nearly fully",
    "de": "könnte kann, mag wird, dürfte wird, müsste muss, wohl gewiss, eventuell gewiss, vermutlich nachweislich, angeblich tatsächlich, manchmal immer, meist immer",
    "es": "podría puede, podrían pueden, debería debe, deberían deben, quizá seguro, acaso seguro, supuestamente efectivamente, aparentemente evidentemente, casi totalmente",
    "fr": "pourrait peut, pourraient peuvent, faudrait faut, peut-être sûrement, apparemment évidemment, parfois toujours, presque entièrement, prétendument réellement",
    "ru": "может должен, могут должны, пожалуй безусловно, наверное безусловно, иногда всегда, обычно всегда, почти совсем, якобы действительно",
    "zh": "可能 必定, 也许 必定, 或许 必定, 大约 正好, 有时 总是, 似乎 确实, 几乎 完全",
}


def _endings(stem: str, endings: str) -> list[str]:
    return [stem + e for e in endings.split(" ")]


def _contracted(verbs: str) -> list[str]:
    """English verbs with a contracted negation, and the verb itself."""
    return [f"{v}n{mark}t {v}" for v in verbs.split(" ") for mark in "'’"]


#: A negation and what is left in its place ("-": nothing). The forms of German "kein" are those of "ein" with a k before it.
NEGATIONS = {
    "en": ", ".join(["not -", "never -", "nowhere everywhere", "nobody everybody", "nothing everything", "cannot can", *[f"{a} {b}" for m in "'’" for a, b in ((f"can{m}t", "can"), (f"won{m}t", "will"), (f"shan{m}t", "shall"))], *_contracted("do does did is are was were has have had would could should must need might")]),
    "de": ", ".join(["nicht -", "nie -", "niemals -", "keinesfalls jedenfalls", "niemand jemand", "nichts etwas", *[f"k{e} {e}" for e in ["ein", *_endings("ein", "e en em er es")]]]),
    "es": "no -, nunca -, jamás -, tampoco también, nadie alguien, nada algo, ningún algún, ninguna alguna",
    "fr": "jamais -, nullement -, aucunement -, sans avec, nulle toute",
    "ru": "не -, нет -, никогда -, ни -, никто кто-то, ничто что-то",
    "zh": "不 -, 没有 -, 没 -, 未 -, 未曾 曾, 并非 是, 别 -",
}
#: Negations in two parts: the words that open one and those that close it. Openers that end in an apostrophe lead a word.
OPENERS = {"fr": "ne n' n’"}
CLOSERS = {"fr": "aucun aucune aucunement guère jamais nul nulle nullement pas personne plus point rien"}
#: Verbs after which a negation goes, whole paradigms; and the negation.
AUXILIARIES = {
    "en": ("not", "am is are was were has have had do does did can could may might must need shall should will would ought".split(" ")),
    "es": ("no", ["he", "has", "ha", "hemos", "habéis", "han", *_endings("hab", "ía ías íamos íais ían"), "soy", "eres", "es", "somos", "sois", "son", *_endings("er", "a as an"), "fue", "fueron", *_endings("est", "oy ás á amos áis án"), *_endings("estab", "a as an"), *_endings("deb", "o es e emos éis en"), *_endings("pued", "o es e en"), *_endings("pod", "emos éis")]),
    "ru": ("не", [*_endings("буд", "у ешь ет ем ете ут"), "был", *_endings("был", "а о и"), "могу", "могут", *_endings("мож", "ешь ет ем ете"), "мог", *_endings("могл", "а о и"), "есть", *_endings("долж", "ен на но ны")]),
}
#: Languages in which it goes before the end of the sentence.
AT_END = {"de": "nicht"}
ORDINALS = {
    "en": "first second third fourth fifth sixth seventh eighth ninth tenth",
    "de": "erste zweite dritte vierte fünfte sechste siebte achte neunte zehnte",
    "es": "primero segundo tercero cuarto quinto sexto séptimo octavo noveno décimo",
    "fr": "premier deuxième troisième quatrième cinquième sixième septième huitième neuvième dixième",
    "ru": "первый второй третий четвёртый пятый шестой седьмой восьмой девятый десятый",
    "zh": "第一 第二 第三 第四 第五 第六 第七 第八 第九 第十",
}


def _pairs(table: str) -> list[tuple[str, str]]:
    return [tuple(p.split(" ")) for p in table.split(", ")]


def rows() -> list[tuple[str, str, str, str]]:
    """All tables as (lang, word, way, put)."""
    out = []
    for lang, t in OPPOSITES.items():
        out += [(lang, a, "antonym", b) for x, y in _pairs(t) for a, b in ((x, y), (y, x))]
    out += [(lang, a, "modal", b) for lang, t in HEDGES.items() for a, b in _pairs(t)]
    out += [(lang, a, "particle", "" if b == "-" else b) for lang, t in NEGATIONS.items() for a, b in _pairs(t)]
    out += [(lang, w, "opener", "") for lang, t in OPENERS.items() for w in t.split(" ")]
    out += [(lang, w, "closer", "") for lang, t in CLOSERS.items() for w in t.split(" ")]
    out += [(lang, w, "auxiliary", negation) for lang, (negation, verbs) in AUXILIARIES.items() for w in verbs]
    out += [(lang, a, "ordinal", b) for lang, t in ORDINALS.items() for a in t.split(" ") for b in t.split(" ") if a != b]
    return out
