"""Dimension tables of the labelling operators, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Raw label (trimmed, lower case) to canonical label. A null is Unknown.
LABELS = {
    "far-left": "Far Left",
    "far left": "Far Left",
    "left": "Left",
    "center-left": "Left",
    "center": "Center",
    "lean-left": "Left",
    "lean left": "Left",
    "center-right": "Right",
    "right": "Right",
    "lean-right": "Right",
    "lean right": "Right",
    "far-right": "Far Right",
    "far right": "Far Right",
    "unknown": "Unknown",
    "": "Unknown",
}

# Order of the canonical labels, in charts and for ties.
LABEL_ORDER = ["Far Left", "Left", "Center", "Right", "Far Right", "Unknown"]

# Chart colour of each label.
COLOURS = {"Far Left": "#0B36B8", "Left": "#275BF5", "Center": "#894AB3", "Right": "#EB4040", "Far Right": "#C43D31", "Unknown": "#C6C6C6"}

# Outlet name to raw label, in declaration order.
OUTLETS = {
    "AlterNet": "far-left",
    "Democracy Now": "far-left",
    "Jacobin": "far-left",
    "AJC": "left",
    "Al Jazeera": "left",
    "Amnesty International": "left",
    "The Atlantic": "left",
    "Bloomberg Opinion": "left",
    "BuzzFeed News": "left",
    "CBC News": "left",
    "Chicago Reader": "left",
    "City Limits": "left",
    "CNN": "left",
    "Current Affairs": "left",
    "Daily Mirror": "left",
    "El País": "left",
    "Global Voices": "left",
    "Grist": "left",
    "The Guardian": "left",
    "Haaretz": "left",
    "HuffPost": "left",
    "Human Rights Watch": "left",
    "Iowa Capital Dispatch": "left",
    "LA Times": "left",
    "Mediaite": "left",
    "The Nation": "left",
    "New York Times": "left",
    "NPR": "left",
    "Philadelphia Inquirer": "left",
    "Politico": "left",
    "ProPublica": "left",
    "Rolling Stone": "left",
    "Slate": "left",
    "The Hindu": "left",
    "The Independent": "left",
    "The Intercept": "left",
    "The New Yorker": "left",
    "Time": "left",
    "Vox": "left",
    "Washington Post": "left",
    "Yahoo News": "left",
    "ABC News": "center",
    "AFP": "center",
    "AP": "center",
    "Associated Press": "center",
    "Axios": "center",
    "Barron's": "center",
    "BBC News": "center",
    "Bloomberg": "center",
    "Business Insider": "center",
    "CBS News": "center",
    "Christian Science Monitor": "center",
    "CNBC": "center",
    "CTV News": "center",
    "DW": "center",
    "Denver Post": "center",
    "Deutsche Welle": "center",
    "Financial Times": "center",
    "Forbes": "center",
    "France 24": "center",
    "Gothamist": "center",
    "Japan Times": "center",
    "MarketWatch": "center",
    "MSN": "center",
    "NBC News": "center",
    "NewsNation": "center",
    "Newsweek": "center",
    "New York Daily News": "center",
    "New Zealand Herald": "center",
    "Nikkei Asia": "center",
    "NPR News": "center",
    "PBS NewsHour": "center",
    "Phoenix New Times": "center",
    "Quartz": "center",
    "Reason": "center",
    "Reuters": "center",
    "RTÉ": "center",
    "Scientific American": "center",
    "Semafor": "center",
    "Sky News": "center",
    "South China Morning Post": "center",
    "STAT News": "center",
    "Straight Arrow News": "center",
    "The Economist": "center",
    "The Hill": "center",
    "The Times of India": "center",
    "USA Today": "center",
    "Wall Street Journal": "center",
    "Westword": "center",
    "WGN - Chicago": "center",
    "WUSA9": "center",
    "Yahoo Finance": "center",
    "AEI": "right",
    "Blaze Media": "right",
    "Boston Herald": "right",
    "CBN": "right",
    "City Journal": "right",
    "Daily Caller": "right",
    "Daily Mail": "right",
    "The Daily Telegraph (Australia)": "right",
    "The Dispatch": "right",
    "The Federalist": "right",
    "Financial Post": "right",
    "Fox Business": "right",
    "Fox News": "right",
    "The Jerusalem Post": "right",
    "Just the News": "right",
    "National Post": "right",
    "National Review": "right",
    "Newsmax": "right",
    "New York Post": "right",
    "RealClearPolitics": "right",
    "The Spectator": "right",
    "The Straits Times": "center",
    "The Telegraph": "right",
    "The Times (UK)": "right",
    "The Wall Street Journal": "right",
    "Upward News": "right",
    "Washington Examiner": "right",
    "Washington Free Beacon": "right",
    "Washington Times": "right",
    "ZeroHedge": "right",
    "Breitbart": "far-right",
    "OAN": "far-right",
    "OANN": "far-right",
    "The Daily Signal": "far-right",
    "The Daily Wire": "far-right",
    "The Epoch Times": "right",
    "The Gateway Pundit": "far-right",
    "The Post Millennial": "far-right",
    "Ars Technica": "left",
    "Der Spiegel": "center",
    "El Mundo": "center",
    "Engadget": "center",
    "Financial News (Dow Jones)": "center",
    "Fortune": "center",
    "Le Figaro": "right",
    "Le Monde": "left",
    "NPR Science": "center",
    "STAT": "center",
    "TechCrunch": "center",
    "The Globe and Mail": "center",
    "The Information": "center",
    "The Japan News (Yomiuri)": "right",
    "The Times of Israel": "center",
    "Wired": "left",
}

# Domain to outlet name.
DOMAINS = {
    "abc.net.au": "ABC News",
    "abcnews.go.com": "ABC News",
    "aei.org": "American Enterprise Institute (AEI)",
    "ajc.com": "Atlanta Journal-Constitution (AJC)",
    "aljazeera.com": "Al Jazeera",
    "allafrica.com": "AllAfrica",
    "apnews.com": "Associated Press",
    "arstechnica.com": "Ars Technica",
    "asia.nikkei.com": "Nikkei Asia",
    "axios.com": "Axios",
    "barrons.com": "Barron's",
    "bbc.co.uk": "BBC News",
    "bbc.com": "BBC News",
    "billypenn.com": "Billy Penn",
    "bloomberg.com": "Bloomberg",
    "bostonherald.com": "Boston Herald",
    "breitbart.com": "Breitbart",
    "businessinsider.com": "Business Insider",
    "buzzfeednews.com": "BuzzFeed News",
    "cbc.ca": "CBC News",
    "cbsnews.com": "CBS News",
    "cbn.com": "CBN",
    "chicago.suntimes.com": "Chicago Sun-Times",
    "chicagoreader.com": "Chicago Reader",
    "chron.com": "Houston Chronicle",
    "city-journal.org": "City Journal",
    "cnbc.com": "CNBC",
    "cnn.com": "CNN",
    "commentary.org": "Commentary Magazine",
    "csmonitor.com": "Christian Science Monitor",
    "ctvnews.ca": "CTV News",
    "currentaffairs.org": "Current Affairs",
    "dailycaller.com": "Daily Caller",
    "dailytelegraph.com.au": "The Daily Telegraph (Australia)",
    "dailymail.co.uk": "Daily Mail",
    "dailymaillive.co.uk": "Daily Mail",
    "dailysignal.com": "The Daily Signal",
    "dailywire.com": "The Daily Wire",
    "denverpost.com": "Denver Post",
    "dw.com": "DW (Deutsche Welle)",
    "economist.com": "The Economist",
    "elmundo.es": "El Mundo",
    "elpais.com": "El País",
    "engadget.com": "Engadget",
    "euronews.com": "Euronews",
    "finance.yahoo.com": "Yahoo Finance",
    "financialnews.com": "Financial News (Dow Jones)",
    "financialpost.com": "Financial Post",
    "fnlondon.com": "Financial News (Dow Jones)",
    "forbes.com": "Forbes",
    "fortune.com": "Fortune",
    "foxbusiness.com": "Fox Business",
    "foxnews.com": "Fox News",
    "france24.com": "France 24",
    "ft.com": "Financial Times",
    "globeandmail.com": "The Globe and Mail",
    "gothamist.com": "Gothamist",
    "guardian.co.uk": "The Guardian",
    "haaretz.com": "Haaretz",
    "huffpost.com": "HuffPost",
    "ijr.com": "Independent Journal Review",
    "independent.co.uk": "The Independent",
    "informationweek.com": "InformationWeek",
    "inquirer.com": "Philadelphia Inquirer",
    "iowacapitaldispatch.com": "Iowa Capital Dispatch",
    "japantimes.co.jp": "Japan Times",
    "jpost.com": "The Jerusalem Post",
    "kabc.com": "KABC - Los Angeles",
    "kff.org": "Kaiser Family Foundation (KFF)",
    "kiro7.com": "KIRO7 - Seattle",
    "khou.com": "KHOU - Houston",
    "kqed.org": "KQED - San Francisco",
    "lefigaro.fr": "Le Figaro",
    "lemonde.fr": "Le Monde",
    "latimes.com": "LA Times",
    "marketwatch.com": "MarketWatch",
    "mediaite.com": "Mediaite",
    "mirror.co.uk": "Daily Mirror",
    "motherjones.com": "Mother Jones",
    "msn.com": "MSN",
    "msnbc.com": "MSNBC",
    "nationalobserver.com": "National Observer",
    "nationalpost.com": "National Post",
    "nationalreview.com": "National Review",
    "nbcnews.com": "NBC News",
    "nbcwashington.com": "NBC4 Washington",
    "newyorker.com": "The New Yorker",
    "news.sky.com": "Sky News",
    "news.yahoo.com": "Yahoo News",
    "newsday.com": "Newsday",
    "newsnationnow.com": "NewsNation",
    "newsweek.com": "Newsweek",
    "npr.org": "NPR",
    "nydailynews.com": "New York Daily News",
    "nypost.com": "New York Post",
    "nyt.com": "New York Times",
    "nytimes.com": "New York Times",
    "nzherald.co.nz": "New Zealand Herald",
    "oann.com": "One America News Network (OANN)",
    "opinionjournal.com": "The Wall Street Journal",
    "pbs.org": "PBS NewsHour",
    "pewresearch.org": "Pew Research Center",
    "phoenixnewtimes.com": "Phoenix New Times",
    "pitchfork.com": "Pitchfork",
    "politico.com": "Politico",
    "postmillennial.com": "The Post Millennial",
    "propublica.org": "ProPublica",
    "qz.com": "Quartz",
    "rand.org": "RAND Corporation",
    "rawstory.com": "Raw Story",
    "reason.com": "Reason",
    "realclearpolitics.com": "RealClearPolitics",
    "reuters.com": "Reuters",
    "rollingstone.com": "Rolling Stone",
    "rte.ie": "RTÉ",
    "rt.com": "RT",
    "scientificamerican.com": "Scientific American",
    "scmp.com": "South China Morning Post",
    "sfchronicle.com": "San Francisco Chronicle",
    "semafor.com": "Semafor",
    "sky.com": "Sky News",
    "slate.com": "Slate",
    "spectator.co.uk": "The Spectator",
    "spiegel.de": "Der Spiegel",
    "statnews.com": "STAT News",
    "startribune.com": "Star Tribune",
    "straitstimes.com": "The Straits Times",
    "straightarrownews.com": "Straight Arrow News",
    "techcrunch.com": "TechCrunch",
    "telegraph.co.uk": "The Telegraph",
    "the-japan-news.com": "The Japan News (Yomiuri)",
    "theinformation.com": "The Information",
    "theatlantic.com": "The Atlantic",
    "thedispatch.com": "The Dispatch",
    "theepochtimes.com": "Epoch Times",
    "thegatewaypundit.com": "The Gateway Pundit",
    "theglobeandmail.com": "The Globe and Mail",
    "theguardian.com": "The Guardian",
    "thehindu.com": "The Hindu",
    "thehill.com": "The Hill",
    "thenation.com": "The Nation",
    "thetimes.co.uk": "The Times (UK)",
    "thestar.com.my": "The Star (Malaysia)",
    "timesofisrael.com": "The Times of Israel",
    "timesofindia.indiatimes.com": "The Times of India",
    "time.com": "Time",
    "upward.news": "Upward News",
    "usatoday.com": "USA Today",
    "vox.com": "Vox",
    "venturebeat.com": "VentureBeat",
    "washingtonexaminer.com": "Washington Examiner",
    "washingtonpost.com": "Washington Post",
    "washingtontimes.com": "Washington Times",
    "westword.com": "Denver Westword",
    "wgntv.com": "WGN - Chicago",
    "willametteweek.com": "Willamette Week",
    "wired.com": "Wired",
    "wsj.com": "Wall Street Journal",
    "wusa9.com": "WUSA9 - Washington, D.C.",
    "yomiuri.co.jp": "The Japan News (Yomiuri)",
}

# Domain to canonical label; these come before any other lookup.
OVERRIDES = {
    "breitbart.com": "Far Right",
    "oann.com": "Far Right",
    "theepochtimes.com": "Far Right",
    "thegatewaypundit.com": "Far Right",
    "foxnews.com": "Right",
    "abc.net.au": "Center",
    "aljazeera.com": "Left",
    "euronews.com": "Center",
    "independent.co.uk": "Left",
    "ft.com": "Center",
    "reuters.com": "Center",
    "apnews.com": "Center",
    "bbc.co.uk": "Center",
    "dw.com": "Center",
    "nbcnews.com": "Center",
    "nytimes.com": "Left",
    "theguardian.com": "Left",
    "cnn.com": "Left",
    "msnbc.com": "Left",
}

# Weight of an outlet's credibility; others weigh 0.
CREDIBILITY = {
    "Associated Press": 1.0,
    "AP": 1.0,
    "Reuters": 1.0,
    "AFP": 1.0,
    "NPR": 1.0,
    "BBC News": 0.9,
    "Deutsche Welle": 0.9,
    "The Wall Street Journal": 0.9,
    "The New York Times": 0.9,
    "Bloomberg": 0.9,
    "Al Jazeera": 0.9,
    "NHK WORLD-JAPAN": 0.9,
    "ABC News (Australia)": 0.9,
    "CBC": 0.9,
    "The Guardian": 0.8,
    "CNN": 0.8,
    "Politico": 0.8,
    "The Hill": 0.8,
    "Yahoo News": 0.8,
    "Fox News": 0.7,
    "MSNBC": 0.7,
    "The Telegraph": 0.7,
    "India Today": 0.7,
    "Daily Wire": 0.6,
    "The Blaze": 0.6,
    "Jacobin": 0.6,
    "Democracy Now": 0.6,
    "Breitbart": 0.5,
    "Epoch Times": 0.5,
    "OANN": 0.4,
    "The Gateway Pundit": 0.3,
    "unknown": 0.0,
}

# Weight of a raw label; others weigh 0.6.
LABEL_WEIGHTS = {
    "center": 1.0,
    "left": 0.8,
    "right": 0.8,
    "far-left": 0.5,
    "far-right": 0.5,
    "unknown": 0.6,
}

# Domain to short outlet name.
SHORT_NAMES = {
    "reuters.com": "Reuters",
    "bbc.com": "BBC",
    "cnn.com": "CNN",
    "nytimes.com": "NYT",
    "foxnews.com": "Fox News",
    "apnews.com": "AP",
    "washingtonpost.com": "Washington Post",
    "theguardian.com": "The Guardian",
    "npr.org": "NPR",
    "bloomberg.com": "Bloomberg",
    "abcnews.go.com": "ABC News",
    "cbsnews.com": "CBS News",
    "politico.com": "Politico",
    "axios.com": "Axios",
}

# Feeds, in reading order.
FEEDS = [
    "https://hub.jhu.edu/rss/home-feed/",
    "https://news.berkeley.edu/feed/",
    "https://news.harvard.edu/gazette/feed/",
    "https://news.psu.edu/rss/rss.xml",
    "https://news.umich.edu/feed/",
    "https://news.uchicago.edu/rss.xml",
    "https://news.utexas.edu/feed/",
    "https://theconversation.com/rss.xml",
    "https://uncnews.unc.edu/feed/",
    "https://www.buffalo.edu/news/rss.xml",
    "https://www.princeton.edu/news/rss.xml",
    "https://www.science.org/rss/news_current.xml",
    "https://www.sciencenews.org/feed/",
    "https://www.washington.edu/news/feed/",
    "http://feeds.bbci.co.uk/news/rss.xml",
    "https://allafrica.com/tools/headlines/rdf/all.rdf",
    "https://foreignpolicy.com/feed/",
    "https://globalvoices.org/feed",
    "https://feeds.a.dj.com/rss/RSSWorldNews.xml",
    "https://feeds.foxnews.com/foxnews/latest",
    "https://feeds.npr.org/1001/rss.xml",
    "https://rss.dw.com/rdf/rss-en-all",
    "https://rss.nytimes.com/services/xml/rss/nyt/World.xml",
    "https://www.abc.net.au/news/feed/51120/rss.xml",
    "https://www.aljazeera.com/xml/rss/all.xml",
    "https://www.euronews.com/rss?level=theme&name=news",
    "https://www.theguardian.com/world/rss",
    "https://www.independent.co.uk/news/world/rss",
    "https://www.latimes.com/world-nation/rss2.0.xml",
    "https://feeds.edweek.org/edweek/topstories",
    "https://feeds.marketwatch.com/marketwatch/topstories/",
    "https://fortune.com/feed/",
    "https://nautil.us/feed",
    "https://pitchfork.com/feed/feed-news/rss",
    "https://thebaffler.com/feed",
    "https://theintercept.com/rss.xml",
    "https://www.newyorker.com/feed/everything",
    "https://www.propublica.org/feeds/articles",
    "https://www.rollingstone.com/feed/",
    "https://www.smithsonianmag.com/rss/",
    "https://www.space.com/feeds/all",
    "https://www.statnews.com/feed/",
    "https://www.techradar.com/rss",
    "https://www.theatlantic.com/feed/all/",
    "https://www.vanityfair.com/vf-rss.xml",
    "https://www.vogue.com/rss",
    "https://www.wired.com/feed/rss",
    "https://billypenn.com/feed",
    "https://chicago.suntimes.com/rss/",
    "https://chicagoreader.com/feed",
    "https://citylimits.org/feed",
    "https://kdvr.com/feed",
    "https://nbcwashington.com/?rss=y",
    "https://news10.com/feed/",
    "https://www.ajc.com/arcio/rss/category/news/",
    "https://www.chron.com/rss/",
    "https://www.inquirer.com/news/nation-world/index.rss",
    "https://www.kabc.com/feed/",
    "https://www.khou.com/rss",
    "https://www.kiro7.com/news/?outputType=rss",
    "https://www.newsday.com/rss",
    "https://www.sfchronicle.com/default/feed/news",
    "https://www.startribune.com/rss/",
    "https://www.wcvb.com/topstories-rss",
    "https://www.wweek.com/feed/",
    "https://www.westword.com/denver/Rss.xml",
    "https://www.wusa9.com/rss",
    "https://wgntv.com/feed/",
    "https://www.wxyz.com/news/rss.xml",
    "https://abcnews.go.com/abcnews/topstories",
    "https://feeds.axios.com/axios/newsroom",
    "https://feeds.feedburner.com/yahoonewsroom",
    "https://rssfeeds.usatoday.com/usatoday-NewsTopStories",
    "https://rssfeeds.usnews.com/usnews/top-news",
    "https://thehill.com/feed/",
    "https://www.breitbart.com/feed/",
    "https://www.cbsnews.com/latest/rss/main",
    "https://www.commentary.org/feed/",
    "https://www.nationalreview.com/feed/",
    "https://www.nbcnews.com/id/3032091/device/rss/rss.xml",
    "https://www.oann.com/feed/",
    "https://www.realclearpolitics.com/index.xml",
    "https://thedispatch.com/feed/",
    "https://www.thebulwark.com/feed/",
    "https://www.theepochtimes.com/feed",
    "https://www.thegatewaypundit.com/feed/",
    "https://www.washingtonexaminer.com/feed",
    "https://www.washingtontimes.com/rss/headlines/news/politics/",
    "https://www.aei.org/feed/",
    "https://www.brookings.edu/feed/",
    "https://www.city-journal.org/rss.xml",
    "https://www.heritage.org/rss/all",
    "https://www.kff.org/feed/",
    "https://www.pewresearch.org/feed/",
    "https://www.rand.org/rss.xml",
    "https://www.urban.org/rss.xml",
]

# Feed to the feed that stands in for it.
FALLBACK_FEEDS = {
    "https://www.breitbart.com/feed/": "https://feeds.feedburner.com/breitbart",
    "https://www.oann.com/feed/": "https://rss.feedspot.com/oann_rss_feeds/",
    "https://www.theepochtimes.com/feed": "https://www.theepochtimes.com/focus/rss",
}

# Tracking keys that URL normalisation drops (exact case).
NORMALISE_DROPS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "igshid", "spm"]

# Tracking keys that the canonical form drops (any case).
CANONICAL_DROPS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "igshid", "si", "s", "ref", "ref_src"]

# Words that image relevance ignores.
IMAGE_STOP = ["the", "and", "for", "with", "from", "into", "amid", "after", "before", "over", "under", "about", "this", "that", "these", "those", "are", "was", "were", "been", "being", "has", "have", "had", "will", "would", "should", "could", "might", "also", "says", "said", "its", "their", "them", "a", "an", "of", "in", "on", "at", "to"]

# Words that the relevance score of a found image ignores.
RELEVANCE_STOP = ["the", "and", "for", "with", "from", "into", "amid", "after", "before", "over", "under", "about", "this", "that", "these", "those", "are", "was", "were", "been", "being", "has", "have", "had", "will", "would", "should", "could", "might", "also", "says", "said"]

# Words that title comparison ignores.
TITLE_STOP = ["a", "an", "the", "and", "or", "but", "to", "of", "for", "in", "on", "at", "over", "under", "after", "before", "with", "without", "by", "from", "as", "about", "into", "during", "including", "until", "against", "among", "between", "through", "because", "so", "since", "due", "has", "have", "had", "is", "was", "are", "were", "be", "been", "being", "will", "would", "should", "may", "might", "can", "could"]

# Words that an image query takes from a summary never.
QUERY_STOP = ["this", "that", "with", "from", "about", "after", "before", "through", "into", "which", "their", "there", "where", "while", "being", "have", "has", "had", "will", "would", "should", "could", "might", "also", "over", "under", "between", "among", "other", "more", "most", "very", "just", "like", "than", "such", "many", "some", "only"]

# Words that are no entity in a headline.
ENTITY_STOP = ["the", "and", "or", "to", "of", "in", "on", "at", "amid", "after", "before", "with", "from", "a", "an"]

# What marks a scanned page instead of a picture.
BAD_IMAGE_WORDS = ["book", "cover", "report", "document", "scan", "scanned", "page", "pages", "volume", "issue", "journal", "catalog", "brochure", "pamphlet", "poster", "manuscript", "handbook", "proceedings", "thesis", "pdf", "title page"]
BAD_IMAGE_ENDINGS = [".pdf", ".djvu", ".tif", ".tiff", ".svg"]
DRAWN_WORDS = ["illustration", "painting", "engraving"]

# Classifier label, category and slug.
CATEGORIES = [
    ("politics and government", "Politics & Government", "politics-government"),
    ("world and international affairs", "Global Affairs", "global-affairs"),
    ("economy and financial markets", "Economy & Markets", "economy-markets"),
    ("business and companies", "Business", "business"),
    ("technology and computing", "Technology", "technology"),
    ("science and health", "Science & Health", "science-health"),
    ("climate and environment", "Climate & Environment", "climate-environment"),
    ("culture and society", "Culture & Society", "culture-society"),
]

# What marks an opinion piece, in its title and in its URL.
OPINION_TITLE = ["opinion", "editorial", "column", "viewpoint"]
OPINION_URL = ["opinion", "editorial", "op-ed", "column"]


def _pairs(spark: SparkSession, rows: dict, schema: str) -> DataFrame:
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows.items())], schema)


def canonical(raw: str) -> str:
    """Canonical form of a raw label: a known one, else in title case."""
    return LABELS.get(raw.strip().lower(), raw.title() if raw else "Unknown")


def outlets(spark: SparkSession) -> DataFrame:
    """name, label (canonical), ord."""
    return _pairs(spark, {k: canonical(v) for k, v in OUTLETS.items()}, "name string, label string, ord int")


def domains(spark: SparkSession) -> DataFrame:
    """domain, name, ord."""
    return _pairs(spark, DOMAINS, "domain string, name string, ord int")


def overrides(spark: SparkSession) -> DataFrame:
    """domain, label, ord."""
    return _pairs(spark, OVERRIDES, "domain string, label string, ord int")
