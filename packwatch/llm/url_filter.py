"""URL filter: rules on host and path, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .kernels import _BYTES, _Q, U64, _runs, mix, utf8

BUCKETS, GRAMS = 1 << 15, (3, 4, 5)
#: How many missed bad urls a wrongly blocked one weighs.
GOOD = 2.0

#: A small labelled table, written by hand: whole urls to block and to allow. None is of the test pages; names stand under a reserved top level.
_BLOCK = """
http://www.grandcasino-online.example/slots/book-of-gold?bonus=200
https://playpokernow.example/register?ref=aff123
https://casino-royal-bet.example/en/live-roulette
http://free-spins-daily.example/jackpot/
https://bet365days.example/sports/football/odds
https://www.luckyslots777.example/login
http://bingo-and-slots.example/promo/win-big.html
https://sportsbetting-tips.example/accumulator/today
http://onlinecasino-nodeposit.example/bonus-codes
https://betting-shop.example/live/tennis?odds=decimal
http://cheapviagra-online.example/buy-viagra.html
https://canadian-pharmacy-rx.example/order/cialis-20mg
http://pills4you.example/no-prescription/tramadol
https://weightloss-miracle.example/diet-pills/order-now
http://buy-generic-meds.example/cart?product=viagra&qty=90
https://www.herbal-enhancement.example/male/
http://discountrx.example/pharmacy/index.php?aff=77
https://hotgirls-cam.example/live/room/19
http://xxx-tube-free.example/videos/amateur/12
https://adultdating-local.example/singles-near-you
http://www.sexchat247.example/webcam
https://nude-gallery.example/pics/018.jpg
http://pornvideos-hd.example/watch?v=881
https://escorts-in-town.example/girls/page3
http://milf-hookup.example/join-free
https://erotic-stories.example/xxx/chapter-2.html
http://ad.doubletrack.example/click?id=99812&redir=http
https://track.adserver.example/banner/468x60.gif
http://clicks.affiliate-net.example/r?a=1&b=2&c=3
https://popads.example/show.php?zone=12
http://pixel.tracker-stats.example/collect?v=1&tid=22
https://ads.banner-exchange.example/impression?site=5
http://syndication.adnetwork.example/ads/serve.js
http://www.free-iphone-winner.example/claim-prize
https://you-won-lottery.example/congratulations?u=me
http://survey-rewards.example/giftcard/win-now
https://get-rich-quick.example/make-money-fast.html
http://bitcoin-doubler.example/invest?ref=moon
https://crypto-giveaway.example/double-your-btc
http://forex-signals-pro.example/guaranteed-profit
http://payday-loans-fast.example/apply-now
https://instant-cash-loan.example/bad-credit-ok
http://replica-watches-shop.example/rolex/cheap
https://cheap-louis-handbags.example/sale/replica
http://fake-id-cards.example/order.html
https://cracked-software.example/warez/keygen.zip
http://serials-and-keygens.example/download/crack.exe
https://free-movie-downloads.example/torrent/full-hd
http://secure-login-paypa1.example/verify/account.php
https://appleid-support-verify.example/signin/update
http://bank-account-locked.example/confirm?session=77ab
https://win-prize-now.example/spin
http://linkdirectory-seo.example/buy-backlinks
https://cheap-seo-links.example/5000-backlinks-for-5
http://spam-blog-network.example/tag/cheap-insurance
https://essay-writing-cheap.example/buy-essay-online
http://followers-for-sale.example/buy-instagram-likes
https://hot-deals-outlet.example/cheap-jerseys-wholesale
http://ringtones-free.example/subscribe?premium=1
https://parked-domain.example/?q=cheap+flights&ads=1
http://best-porn-sites.example/top/xxx-videos
https://www.xxx-live-cams.example/porn/free
http://teenporn-archive.example/galleries/xxx
https://sex-movies.example/porn/clip/77
http://naked-celebs.example/xxx/photos
https://porno-gratis.example/videos/sexo
http://kasino-spiele-gratis.example/automaten/bonus
https://casino-en-ligne.example/jeux/roulette-bonus
http://apuestas-deportivas.example/casino/bono
https://mega-slots.example/casino/free-spins
http://vegas-casino-games.example/blackjack/real-money
https://pokies-online.example/casino/deposit
https://pharmacie-sans-ordonnance.example/viagra-generique
http://cheap-meds-store.example/buy-cialis-online
https://levitra-discount.example/order-pills
http://adserve-media.example/ads/click?banner=3
https://click-tracking.example/track/redirect?url=1
http://spam-mailer.example/bulk-email/buy
https://win-free-cash.example/prize/claim
http://free-gift-cards.example/win/survey
""".split()
_ALLOW = """
https://www.citylibrary.example/catalogue/search?q=history
https://news.rivertown.example/2021/03/14/bridge-opens
http://www.university-north.example/physics/lectures/quantum.html
https://docs.opentool.example/en/latest/install.html
https://blog.gardenclub.example/roses-in-winter/
http://museum-of-transport.example/exhibitions/steam
https://journal-of-geology.example/article/10.1234/abc.567
https://www.weatheroffice.example/forecast/coast
http://recipes.homecooking.example/bread/sourdough.html
https://forum.woodworkers.example/viewtopic.php?t=4821
https://www.parliament-records.example/debates/1998-05-12
http://genealogy.smithfamily.example/tree/1820.htm
https://en.encyclopedia.example/wiki/Glacier
http://schoolboard.example/calendar/2019
https://health.gov.example/vaccines/measles
https://statistics.gov.example/census/2011/tables.csv
http://www.mountainhut.example/trails/ridge-walk
https://code.repository.example/user/project/issues/12
https://lists.developers.example/archive/2004-July/0031.html
http://www.theatre-guild.example/season/programme
https://chess-federation.example/tournaments/results
http://birdwatch.example/species/kingfisher
https://orchestra.example/concerts/spring
http://local-gazette.example/sport/cricket-report
https://law-review.example/volume12/property-rights
https://www.farmersmarket.example/stalls
http://astronomy-society.example/observing/comet
https://translation.example/dictionary/german-english/haus
http://railway-history.example/lines/branch/stations
https://nursing-journal.example/issue/44/pain-management
https://philosophy.example/entries/kant-moral/
http://sailing.example/knots/bowline
https://insurance-regulator.example/annual-report-2016.pdf
http://pottery.example/glazes
https://economics-institute.example/papers/wp-201.pdf
http://kindergarten.example/parents/letter
https://www.nationalpark.example/visit/camping
http://poems.example/sonnets/18
https://travel-notes.example/asia/nepal/day-4
http://filmarchive.example/silent/1922
https://architecture.example/buildings/town-hall
http://linguistics.example/phonology/vowels
https://www.hospital-trust.example/departments/cardiology
http://marathon.example/results/2015
https://cheese-makers.example/varieties
http://geography.example/rivers/danube
https://energy-agency.example/reports/wind
http://church-choir.example/rehearsals
https://software-patterns.example/observer
http://veterinary.example/cats/diet
https://photography.example/lenses/review
http://public-radio.example/shows/morning/2018-02-01
https://bank-of-england-history.example/notes
http://antiques.example/clocks/longcase
https://online-courses.example/statistics/week-3
http://free-software.example/licenses/gpl.html
https://buyers-guide.example/washing-machines/energy
http://poker-theory.example/mathematics/probability
https://pharmacology.example/drugs/aspirin
http://sexual-health.example/clinics/advice
https://lottery-history.example/sixteenth-century
http://advertising-museum.example/posters/1930s
https://credit-union.example/members/meeting
http://www.tax-office.example/forms/income
https://winter-sports.example/skiing/nordic
http://thesis.example/handle/1234/5678
https://mathematics.example/proofs/primes
http://folklore.example/tales/the-north-wind
https://www.village-council.example/minutes/2009
http://lighthouse.example/keepers
https://cycling.example/repair/brakes
http://oldmaps.example/county/1842
https://anthropology.example/fieldwork/island
http://teachers.example/lesson-plans/fractions
https://fisheries.example/herring/catches
http://meteorology.example/clouds
https://dental.example/children
http://interview.example/authors/novelist
https://startup-news.example/funding/2020
http://shipping-history.example/clippers
https://legal-aid.example/housing
http://beekeeping.example/hives
https://letters.example/archive/1861
http://opera.example/libretto/act2
https://woodland-trust.example/oak
http://computing-history.example/mainframes
https://www.bookreview.example/fiction/2013
http://chemistry.example/elements/iron
https://refugees.example/stories
http://allotment.example/compost
https://www.cinema-listings.example/tonight
http://village-shop.example/opening-hours
https://freedom-of-information.example/requests
http://windmill.example/grinding
https://playgroup.example/mornings
http://cashmere-goats.example/breeding
https://essex-county.example/history
http://betting-law.example/acts/1845
https://cams-and-valves.example/engines
http://prize-winning-novels.example/shortlist
https://free-church.example/sermons
http://pillow-lace.example/patterns
""".split()
LABELLED_URLS = [(url, label) for urls, label in ((_BLOCK, 1), (_ALLOW, 0)) for url in urls]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """What stands behind the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    host = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.host + rule.path).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram of bytes."""
    data, offsets = utf8(column)
    values = _BYTES[data]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, buckets = [], []
    for n in GRAMS:
        at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :]) if len(text) >= n else np.zeros(0, np.int64)
        rows.append(text[at])
        buckets.append((mix(_runs(values, at, at + n, _Q) + U64(n)) % U64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def _sums(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    rows, buckets = _grams(column)
    n = np.maximum(np.bincount(rows, minlength=len(column)), 1)
    return np.bincount(rows, weights=weights[buckets], minlength=len(column)) / np.sqrt(n)


def _text(host: str, path: str) -> str:
    return f"{host} {path}"


def train(urls: list[tuple[str, int]], steps: int = 300, rate: float = 1.0, ridge: float = 1e-4, good: float = GOOD) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression on (url, label) rows, by gradient descent; a row with label 0 counts ``good`` times."""
    texts = []
    for url, _ in urls:
        after = url.split("://", 1)[-1]
        host = after.split("/")[0].split("?")[0].split("#")[0]
        texts.append(_text(host.lower(), after[len(host) :].split("?")[0].split("#")[0]))
    column, y = pa.array(texts), np.array([label for _, label in urls], dtype=float)
    rows, buckets = _grams(column)
    n = np.sqrt(np.maximum(np.bincount(rows, minlength=len(texts)), 1))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(_sums(w, column) + b)))
        miss = (p - y) * np.where(y == 0, good, 1.0) / len(y)
        w -= rate * (np.bincount(buckets, weights=(miss / n)[rows], minlength=BUCKETS) * len(y) ** 0.5 + ridge * w)
        b -= rate * miss.sum()
    return w, b


def judge(pages: DataFrame, rules: list[Rule] | None = None, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """A verdict for each page's url.

    pages: any frame with an id and a url; other columns are not read.
    Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased;
    path: then up to "?", "#" or the end; both are empty for a null url or one
    without "://".  A rule fits its host and all subdomains if the path starts with
    the rule's; the longest wins.
    Returns page_id, host, path, rule (as text, null if none fits), verdict (the
    rule's, else block from ``threshold`` on), score (chance of a bad url).  Repeated
    rows and rows without an id keep their own rows; an empty table gives an empty table.
    """
    weights, offset = train(labelled or LABELLED_URLS)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-(_sums(weights, pa.array(texts, pa.string())) + offset))))

    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = rows.withColumns({"rule": rule, "by_rule": verdict, "score": score(F.concat_ws(" ", "host", "path"))})
    by_score = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_score).alias("verdict"), "score")
