"""Quality rules on lines: a linear-chain conditional random field marks content and boilerplate.

Each line has a few binary features; weights of features and of transitions are
fitted to a small table of labelled line sequences, and Viterbi decoding labels
the lines of a document together.  The share of words in content lines decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import _BYTES, _P, _runs, covered, hashed_words

CONTENT, BOILERPLATE = 0, 1
_KEYWORDS = [b"cookie", b"copyright", b"rights reserved", b"privacy", b"subscribe", b"newsletter", b"log in", b"sign up", b"terms of", b"click here", b"read more", b"share this", b"home |", b"menu", b"next page", b"contact us", b"follow us", b"http://", b"https://"]
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER, _LETTER = np.isin(np.arange(256), list(range(65, 91))), np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGIT, _END = np.isin(np.arange(256), list(range(48, 58))), np.isin(np.arange(256), list(b".!?:;\"')")) | np.isin(np.arange(256), [0xBB, 0x9D, 0xA6])
FEATURES = ["always", "no_words", "one_to_three", "four_to_nine", "ten_or_more", "ends_sentence", "much_upper", "some_symbols", "many_symbols", "many_digits", "keyword", "seen_before", "few_distinct", "long_words", "first", "last", "exclaims", "repeats_next"]

#: Labelled line sequences, written by hand: c content, b boilerplate.
LABELLED_LINES = [
    "b Home | News | Sport | Contact\nb Log in\nc The river rose again on Monday and the lower meadows are under water.\nc Farmers moved their cattle to the hills, and the school bus took the long way round.\nc Nobody was hurt.\nb Share this\nb Copyright 2021. All rights reserved.",
    "c A good bread needs time more than anything else.\nc Mix flour, water and salt, and let the dough rest for an hour before you knead it.\nc Bake it hot.\nb Subscribe to our newsletter\nb Privacy | Terms of use",
    "b MENU\nb Search\nb We use cookies to improve this site.\nc In the spring of that year the two brothers opened a workshop behind the station.\nc It stayed open for forty years, and many of the clocks they made there still run.\nb Read more\nb Next page",
    "c El museo abre todos los dias menos el lunes, y la entrada es libre.\nc La sala grande guarda pinturas de tres siglos.\nc Hay visitas por la tarde.",
    "c Der Zug fuhr langsam durch das Tal, und alle sahen aus dem Fenster.\nc Im Dorf wartete niemand.\nb Impressum | Datenschutz\nb Copyright 2019",
    "c Les enfants jouaient dans la cour pendant que la pluie tombait sur le toit.\nc Personne ne parlait.\nb Accueil | Contact | Plan du site",
    "b Sign up for our newsletter today.\nc The harbour wall was built by hand, and it took eleven winters.\nc Two of the men who built it are buried beside it.\nb Copyright 2016 by the publisher. All rights reserved.",
    "b By using this site you accept our cookies.\nc Snow fell on the pass in June, and the road was shut until the plough came.\nb Read more in our privacy notice.\nb All rights reserved.",
    "c She bought a lamp, a chair and a small table at the sale; the lamp was broken.\nc Did you see it? I did!\nc They paid 40 dollars for the lot, and nobody complained.\nc An old man carried it home.",
    "c El viento movia las ramas y la casa estaba en silencio, como siempre a esa hora.\nc Nadie dijo nada durante la cena, porque todos pensaban en la carta que habia llegado por la manana\nc y que aun estaba cerrada.",
    "c This work is licensed under the terms that follow.\nc She wrote to her sister every week, and the letters are kept in the town archive.\nc Most of them are short\nc and some were never sent.",
    "c Water boils at a lower temperature in the mountains, because the air is thinner there.\nc This is why rice takes longer to cook.\nc Short lines happen too.\nc In 1998 there were 3 of them, in 2004 there were 12.",
    "b 12/03/2020 14:55\nb 0 comments\nc The bridge will be closed for two weeks while its northern pier is repaired.\nc Buses go by way of the mill.\nb Tags: bridge, traffic\nb Follow us",
    "b Shop All | New Arrivals | Women | Men | Kids | Home & Garden | Beauty | Sale | Gift Cards | Stores | Help\nb Free delivery on orders over $50\nc The wool comes from sheep that graze on the islands all year round.\nc It is spun, dyed and knitted within twenty miles of the farm.\nb Add to cart\nb You may also like\nb Wool hat $24.00 | Wool scarf $38.00 | Gloves $19.50 | Socks $12.00",
    "b SUMMER SALE NOW ON!! UP TO 50% OFF!! FREE SHIPPING!!\nb Hurry, offer ends Sunday! Use code SUN20 at checkout!\nc Our tents are made for wind and rain, and we test each one on the hill behind the shop.\nb Buy now $199.99\nb * Terms and conditions apply. ** While stocks last.",
    "b Tags: travel travel-tips travel-blog cheap-travel budget-travel travel-insurance\nb cheap flights cheap hotels cheap car hire cheap flights london cheap flights paris cheap hotels rome cheap hotels paris\nb Page 1 2 3 4 5 6 7 8 9 10 Next >> Last >>",
    "b Mon Tue Wed Thu Fri Sat Sun\nb 1 2 3 4 5 6 7 8 9 10 11 12 13 14\nb << Jan Mar >>\nc The council met on Tuesday and agreed to plant forty lime trees along the old canal.\nc Work will begin after the frost.\nb Posted by admin in Uncategorized | 3 Comments | Permalink",
    "b Name | Price | Change | % | Volume | High | Low\nb ABC Corp | 12.31 | +0.11 | 0.9% | 120,300 | 12.40 | 12.10\nb XYZ Ltd | 7.02 | -0.05 | -0.7% | 88,140 | 7.11 | 6.98\nb Data delayed by 15 minutes. Privacy | Terms",
    "c I have used this saw for two winters, and the blade is still sharp.\nc The handle could be a little longer.\nb Was this review helpful? Yes (12) | No (3) | Report\nb ***** 5 stars (41)\nb **** 4 stars (12)\nb See all reviews",
    "b # Login # Register # FAQ # Search # Memberlist #\nb View unanswered posts | View active topics | Mark forums read\nc The pump stopped again last night, so I took it apart and found sand in the valve.\nc A new seal fixed it.\nb Quote | Reply | Report | Like (2)\nb _________________",
    "b Loading... Please wait...\nb Loading... Please wait...\nb Error 404: page not found! Go back to the home page or use the search box.\nb Sitemap | Accessibility | Contact us",
    "b AUSTRIA | BELGIUM | CANADA | DENMARK | FRANCE | GERMANY | ITALY | JAPAN | SPAIN | SWEDEN | UK | USA\nb Choose your country\nc Since 1921 the family has made paper by hand in the same mill.\nc Visitors are welcome on weekdays, and children may try the press.\nb Follow us on Facebook | Twitter | Instagram | YouTube",
    "c La maison fut vendue au printemps, et la famille partit vers le sud.\nc On ne la revit plus au village.\nb Partager | Imprimer | Envoyer par e-mail | Commentaires (4)\nb Mentions légales | Données personnelles | Cookies",
    "b WIN a weekend in Paris!! Enter our free prize draw today!!\nb Call now 0800 123 456!\nb No purchase necessary. See rules for details.\nc The paper has been printed in this town since the railway came.\nb Subscribe now from only $1 a week!",
    "b Kleinanzeigen | Immobilien | Stellen | Auto | Reisen | Trauer | Wetter | Abo\nc Die Brücke wird im Herbst erneuert, und der Verkehr fließt so lange über die alte Straße.\nc Der Bus fährt weiter.\nb Teilen | Drucken | Merken\nb Jetzt anmelden! Nur 3 Euro!",
    'b function toggle(id) { var e = document.getElementById(id); if (e) { e.style.display = \'none\'; } }\nb <a href="/index.php?id=12&lang=en&page=3">more</a>\nc The orchard was planted by monks, and some of the trees still bear fruit.\nb {{ item.title }} | {{ item.price }} | ${total}',
    'c In the second year the wheat failed and the village lived on barley and fish.\nc Many left for the coast; those who stayed shared what they had.\nc "We were hungry," she said, "but nobody was alone."\nc The old mill is all that is left of that time.',
    "c El agua llega a la plaza por un canal antiguo que todavía funciona.\nc Los vecinos lo limpian cada primavera.\nb Compartir | Imprimir | Me gusta (15)\nb Aviso legal | Política de cookies | Contacto",
]


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line; a text has one more line than line feeds."""
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.r_[offsets[:-1], feeds + 1], kind="stable")
    end = np.sort(np.r_[offsets[1:], feeds], kind="stable")
    n = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
    return start, end, np.repeat(np.arange(len(offsets) - 1), n)


def line_features(data, offsets, words):
    """Feature matrix of the lines, their texts, words, and which repeat an earlier line of the text that has a word."""
    start, end, text = line_bounds(data, offsets)
    # an empty text that follows a line feed shares its place with another line: order by text, then place
    first_word, last_word = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    n = last_word - first_word
    sums = lambda flags: (lambda c: c[end] - c[start])(np.r_[0, np.cumsum(flags)])
    h = _runs(_BYTES[data], start, end, _P)
    order = np.lexsort((np.arange(len(h)), h, text))
    seen = np.zeros(len(h), dtype=bool)
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    seen[order[1:]] = same
    seen &= n > 0
    line_of_word = np.repeat(np.arange(len(n)), n)
    by_line = np.lexsort((words.hash, line_of_word))
    l, wh = line_of_word[by_line], words.hash[by_line]
    new = np.r_[True, (wh[1:] != wh[:-1]) | (l[1:] != l[:-1])] if len(l) else np.zeros(0, bool)
    distinct = np.bincount(l[new], minlength=len(n))[: len(n)]
    size = np.maximum(end - start, 1)
    last_byte = np.where(n > 0, data[np.maximum(words.end[np.maximum(last_word - 1, 0)] - 1, 0)] if len(words) else 0, 0).astype(int)
    again = np.bincount(line_of_word[1:][(words.hash[1:] == words.hash[:-1]) & (line_of_word[1:] == line_of_word[:-1])], minlength=len(n))[: len(n)]
    letters, some = np.maximum(sums(_LETTER[data]), 1), np.maximum(n, 1)
    symbols = sums(_SYMBOLS[data])
    keyword = np.zeros(len(n), dtype=bool)
    raw = data.tobytes().lower()
    for k in _KEYWORDS:
        at = raw.find(k)
        while at >= 0:
            line = np.searchsorted(start, at, side="right") - 1
            keyword[line] |= at + len(k) <= end[line]  # a keyword stands within one line of one text
            at = raw.find(k, at + 1)
    edge = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, bool)
    x = np.stack([
        np.ones(len(n)), n == 0, (n > 0) & (n <= 3), (n > 3) & (n <= 9), n > 9, _END[last_byte], sums(_UPPER[data]) > 0.5 * letters,
        symbols > 0.05 * some, symbols > 0.25 * some, sums(_DIGIT[data]) > 0.3 * size, keyword, seen, (distinct < 0.35 * n) & (n > 5),
        (end - start) > 30 * some, edge, np.r_[edge[1:], True] if len(edge) else edge,
        sums(data == 33) > 0.2 * some, again > 0.2 * some,
    ], axis=1).astype(float)
    return x, text, n, seen


def train(documents: list[str] | None = None, steps: int = 400, rate: float = 0.2, ridge: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and transitions (2 x 2) of largest penalised likelihood, by gradient ascent with forward-backward sums."""
    sequences = []
    for document in documents or LABELLED_LINES:
        lines = [line.split(" ", 1) for line in document.split("\n")]
        for *_, data, offsets, words in hashed_words(pa.array(["\n".join(x for _, x in lines)])):
            sequences.append((line_features(data, offsets, words)[0], np.array([BOILERPLATE if y == "b" else CONTENT for y, _ in lines])))
    w, t = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    for _ in range(steps):
        gw, gt = -ridge * w, -ridge * t
        for x, y in sequences:
            s = x @ w
            forward, back = np.zeros_like(s), np.zeros_like(s)
            forward[0] = s[0]
            for k in range(1, len(s)):
                forward[k] = s[k] + np.logaddexp.reduce(forward[k - 1][:, None] + t, axis=0)
            for k in range(len(s) - 2, -1, -1):
                back[k] = np.logaddexp.reduce(t + s[k + 1] + back[k + 1], axis=1)
            total = np.logaddexp.reduce(forward[-1])
            gw += x.T @ (np.eye(2)[y] - np.exp(forward + back - total))
            for k in range(1, len(s)):
                gt -= np.exp(forward[k - 1][:, None] + t + s[k] + back[k] - total)
                gt[y[k - 1], y[k]] += 1
        w, t = w + rate * gw / len(sequences), t + rate * gt / len(sequences)
    return w, t


def viterbi(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best labels of many sequences at once; sequence k has rows first[k] to first[k+1]."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    most = int(length.max()) if len(length) else 0
    back = np.zeros((len(scores), 2), dtype=np.int8)
    best = scores[first[:-1][order]] if most else np.zeros((0, 2))
    sizes = length[order]
    for k in range(1, most):
        live = int(np.searchsorted(-sizes, -k, side="left"))
        options = best[:live, :, None] + transitions
        rows = first[:-1][order[:live]] + k
        back[rows] = options.argmax(1)
        best[:live] = options.max(1) + scores[rows]
    labels = np.zeros(len(scores), dtype=np.int8)
    state = best.argmax(1) if most else np.zeros(0, int)
    for k in range(most - 1, -1, -1):
        live = int(np.searchsorted(-sizes, -k, side="left"))
        rows = first[:-1][order[:live]] + k
        labels[rows] = state[:live]
        state[:live] = back[rows, state[:live]]
    return labels


def judged(docs: DataFrame, least_content: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and a verdict for each whole text.

    docs: any frame with an id and a text; other columns are ignored.  Words are
    split at ASCII white space, lines at line feeds.
    Returns doc_id, n_words, word_chars (code points in words), n_symbols
    (characters of #*$%&|<>), n_dup_lines (lines with a word that equal an earlier
    one), n_repeat_words (words in runs of 8 found twice or more), base_failed
    (fewer than 20 words, or over 30% repeated), kept (not base_failed and
    content_share at least ``least_content``), content_share (of words, in lines
    labelled content; 0 without words), line_labels.  A verdict depends on its own text
    alone.  Null is empty and fails; rows that share an id or have none keep their own
    rows; an empty table gives an empty table.
    """
    weights, transitions = train()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def counted(batches):
        for batch in batches:
            for i, j, data, offsets, w in hashed_words(batch.column("text")):
                x, text, n, seen = line_features(data, offsets, w)
                first = np.searchsorted(text, np.arange(j - i + 1))
                labels = viterbi(x @ weights, first, transitions)
                sums = lambda flags: (lambda c: c[offsets[1:]] - c[offsets[:-1]])(np.r_[0, np.cumsum(flags)])
                space = (data == 32) | ((data >= 9) & (data <= 13))
                content = np.bincount(text, weights=n * (labels == CONTENT), minlength=j - i)
                at, h = w.windows(8)
                order = np.lexsort((h, w.text[at]))
                t, v = w.text[at][order], h[order]
                twice = (v[1:] == v[:-1]) & (t[1:] == t[:-1])
                again = np.zeros(len(v), dtype=bool)
                again[1:] |= twice
                again[:-1] |= twice
                repeated = covered(len(w), at[order[again]], 8)
                numbers = [w.count, sums(~space & ((data & 0xC0) != 0x80)), sums(_SYMBOLS[data]), np.bincount(text, weights=seen, minlength=j - i), np.bincount(w.text, weights=repeated, minlength=j - i)[: j - i]]
                marks = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(labels.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *[pa.array(np.asarray(v).astype(np.int64)) for v in numbers], pa.array(content / np.maximum(w.count, 1)), marks], ["doc_id", *names, "content_share", "line_labels"])

    out = rows.mapInArrow(counted, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", content_share double, line_labels array<int>")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", *names, failed.alias("base_failed"), (~failed & (F.col("content_share") >= least_content)).alias("kept"), "content_share", "line_labels")
