"""URL filters: fixed host and path rules, and a weighted vocabulary matched by an Aho-Corasick automaton.

The longest rule that fits decides. Without one, the automaton finds all terms of the vocabulary in one pass over the
URL; a hit counts if no letter or digit adjoins it. One strict term blocks, and so do distinct soft terms whose weights
reach the limit.

Defined results: a null URL, or one without "://", has an empty host and path and fits no rule; an empty URL holds no
term and is allowed; repeated rows are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: The vocabulary, in English, French, German and Spanish: strict terms block alone, soft ones by weight.
STRICT = tuple(
    "porn porno porns pornos pornstar pornstars xxx xxxvideos nsfw hentai milf camgirl camgirls camsex webcamsex sexcam sexcams "
    "casino casinos kasino viagra cialis levitra escort escorts warez keygen keygens cracked crackz serialz "
    "gratisporno pornofilm pornofilme sexfilm sexfilme sexkontakte erotikchat hurenportal "
    "pornographie filmporno sexegratuit plancul "
    "pornografia videosporno sexogratis putas".split()
)
SOFT = {
    term: weight
    for weight, terms in (
        (1.0, "adult sex sexy nude naked erotic erotica betting poker gambling jackpot roulette blackjack sportsbet pills steroids torrent torrents crack spam clickbait"),
        (0.5, "dating hookup singles cam bet bets slots bonus loan loans payday credit refinance pharmacy replica replicas cheap discount free winner prize lottery bitcoin forex followers"),
        (1.0, "erotique nue nues paris-sportifs jeux-argent pilules casse"),
        (0.5, "rencontre rencontres gratuit gratuits pret credits remise gagnant loterie contrefacon"),
        (1.0, "erotik nackt nackte sportwetten gluecksspiel spielautomaten wetten potenzmittel"),
        (0.5, "kontakte gratis kredit kredite sofortkredit billig rabatt gewinnspiel lotto faelschung"),
        (1.0, "erotico desnuda desnudas apuestas tragaperras ruleta pastillas"),
        (0.5, "citas solteras prestamo prestamos barato descuento ganador loteria replicas-relojes"),
    )
    for term in terms.split()
}
SOFT_LIMIT = 2.0

_LOWER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for c in "?#" if (i := rest.find(c)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    at = rest.find("/")
    return (rest.translate(_LOWER), "") if at < 0 else (rest[:at].translate(_LOWER), rest[at:])


class UrlJudge:
    def __init__(self, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Mapping[str, float] = SOFT, limit: float = SOFT_LIMIT):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        for found in self.by_host.values():
            found.sort(key=lambda r: -len(r[0]))
        self.soft, self.limit = dict(soft), limit
        self.terms = ahocorasick.Automaton()
        for t in (*soft, *strict):
            self.terms.add_word(t, t)
        self.strict = frozenset(strict)
        if len(self.terms):
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits: its name and verdict."""
        labels, best = host.split("."), None
        for i in range(len(labels)):
            own = ".".join(labels[i:])
            for rule_path, verdict in self.by_host.get(own, ()):
                if path.startswith(rule_path):
                    name = own + rule_path
                    if best is None or len(name) > len(best[0]):
                        best = name, verdict
                    break
        return best

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms of a URL."""
        low, strict, soft = url.translate(_LOWER), set(), set()
        if not len(self.terms):
            return strict, soft
        apart = lambda i: i < 0 or i >= len(low) or not (low[i].isascii() and low[i].isalnum())
        for end, term in self.terms.iter(low):
            if apart(end + 1) and apart(end - len(term)):
                (strict if term in self.strict else soft).add(term)
        return strict, soft

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int, float]:
        """host, path, rule, verdict, distinct strict terms, distinct soft terms, weight of the soft ones."""
        host, path = split_url(url)
        rule = self.rule(host, path)
        strict, soft = self.hits(url or "")
        weight = float(sum(self.soft[t] for t in soft))
        verdict = rule[1] if rule else "block" if strict or weight >= self.limit else "allow"
        return host, path, rule and rule[0], verdict, len(strict), len(soft), weight


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """id, host, path, rule, verdict, and the terms counted, of every row."""
    kind = pages.schema[id_col].dataType.simpleString()
    fields = "host string, path string, rule string, verdict string, n_strict int, n_soft int, soft_weight double"
    types = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = UrlJudge(**options)
        for b in batches:
            cols = list(zip(*map(own.judge, b.column("url").to_pylist()))) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id", *(f.split()[0] for f in fields.split(", "))])

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    return rows.mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)
