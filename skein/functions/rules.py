"""Screens of the news model: relevance, teasers, paragraph scrub, risks, names, deals, headlines, plain words. All are Catalyst expressions.

The lists and patterns in capitals are fixed values: results depend on them word by word. Patterns have no look-around, so that other engines
can run them as they stand; case doesn't matter unless a pattern is said to be exact.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.text import let

# -- fixed values: subject patterns and their weights -----------------------------------------------------------------------------------

RELEVANCE = [
    (r"\b(ai|a\.i\.)\b", 2), (r"artificial intelligence", 3), (r"machine learning", 3), (r"\bml\b", 1), (r"\b(llm|llms)\b", 3),
    (r"large language model", 3), (r"language model", 2), (r"foundation model", 3), (r"\bgpt-?\d", 3), (r"\bchatgpt\b", 3),
    (r"\bopenai\b", 3), (r"\banthropic\b", 3), (r"\bclaude\b", 2), (r"\bgemini\b", 2), (r"\bdeepmind\b", 3),
    (r"\bllama\b", 2), (r"\bmistral\b", 2), (r"\bcopilot\b", 2), (r"\bnvidia\b", 2), (r"\bgpu(s)?\b", 1),
    (r"\btpu(s)?\b", 2), (r"neural network", 3), (r"deep learning", 3), (r"\btransformer(s)?\b", 2), (r"generative", 2),
    (r"diffusion model", 3), (r"\bagent(s|ic)?\b", 1), (r"\bchatbot(s)?\b", 2), (r"\brobot(s|ics)?\b", 1), (r"humanoid", 2),
    (r"autonomous", 1), (r"\binference\b", 2), (r"fine-?tun", 2), (r"\brag\b", 1), (r"embedding(s)?", 1),
    (r"hallucinat", 2), (r"\balignment\b", 1), (r"\bai act\b", 3), (r"superintelligen", 3), (r"\bagi\b", 3),
    (r"hugging face", 3), (r"\bxai\b", 2), (r"\bgrok\b", 2), (r"\bperplexity\b", 2), (r"\bcursor\b", 1),
    (r"data cent(er|re)", 1), (r"\bmultimodal\b", 3), (r"text-to-(image|video|speech)", 3), (r"\bsora\b", 2), (r"\bmidjourney\b", 3),
]
#: Characters of a body that count.
RELEVANCE_BODY = 6000

# -- fixed values: blocked titles, domains and press releases ---------------------------------------------------------------------------

BLOCKED_TITLE = (
    r"\b(porn|xxx|sex|nude|casino|betting|slots|crypto casino|coupon|promo code|discount code|webinar|eventbrite|register now|hiring|job opening|we're hiring|"
    r"vacanc|giveaway|sweepstake|horoscope|lottery|essay writing service|buy followers)\b"
)
BLOCKED_DOMAINS = [
    "eventbrite.com", "eventbrite.co.uk", "meetup.com", "indeed.com", "glassdoor.com", "linkedin.com", "prnewswire.com", "globenewswire.com", "businesswire.com",
    "einpresswire.com", "openpr.com", "medium.com", "dev.to", "quora.com", "pinterest.com", "slideshare.net", "scribd.com",
]
PRESS_RELEASE = r"\b(press release|pr newswire|globe ?newswire|business wire|for immediate release)\b"

# -- fixed values: subscription teasers -------------------------------------------------------------------------------------------------

TEASER = (
    r"\b(?:subscribe to (?:unlock|read|continue|access|get)|sign in to (?:read|continue|unlock|access)|log ?in to (?:read|continue|unlock)|"
    r"already (?:a|an) (?:subscriber|member)|start your (?:free )?trial|(?:try|start|get) unlimited access|subscribers? only|for subscribers|"
    r"premium (?:content|article)|unlock (?:this|all|the) (?:article|story|content)|(?:complete|full) digital access|cancel anytime|"
    r"(?:\$|€|£)\s?\d+(?:\.\d+)? (?:for|per) (?:\d+ )?(?:weeks?|months?|year)|was undefined|now undefined|\bundefined\b)"
)
STRONG_TEASER = r"\b(?:subscribe to (?:unlock|read|continue)|was undefined|now undefined|\bundefined\b)"
#: Words below which nothing is an article, and up to which a pitch makes a teaser; share of the feed's own copy below which a text is one.
TEASER_FLOOR, TEASER_MOST, TEASER_SHARE = 60, 400, 0.3

# -- fixed values: paragraphs that aren't article text ----------------------------------------------------------------------------------

DROPPED = (
    r"^\s*(\**)?(sponsored|advertisement|advertising|ad feedback|more for you|more from|related( articles| stories| posts| content)?|recommended( for you| stories)?|"
    r"you may also like|you might also like|trending( now)?|most (read|popular)|read (more|next|also)|also read|see also|subscribe( now| today)?|sign (in|up)|log in|"
    r"share( this)?|follow us|newsletter|cookie|privacy policy|terms of (use|service)|all rights reserved|copyright ©|©|image( credit)?s?:|photo( credit)?:|getty images|"
    r"shutterstock|click here|listen to this article|watch:|loading\.\.\.|comments?|leave a (reply|comment)|tags?:|filed under|topics?:|source:|via |originally published|"
    r"this article (was|first) appeared|the post .* appeared first on|disclosure:|editor'?s note|updated?:|correction:|table of contents|skip to (main )?content|"
    r"open in app|download (the|our) app|follow (us|[a-z' ]+ on (google news|x|twitter|facebook|linkedin|instagram))|in partnership with|presented by|brought to you by|"
    r"paid (content|post)|get [a-z' ]+ (best )?(news|stories|reviews|analysis)[^.]*inbox|sign up (for|to)|we'?re ending our live coverage|[a-z0-9._-]+·\d+[hdm])\b.*$"
)
INBOX = (
    r"\b(straight to your inbox|in your inbox|add us as a preferred source|preferred source|curated by|if you would like to submit a response|this is an edition of|"
    r"sign up (for|to) (the|our) newsletter|subscribe to (the|our) newsletter|do you have information about this story|contact (us|the author)|"
    r"this story (was|has been) updated|have a tip\??|reach (me|us) (at|on)|listen to (our|the) podcast|watch (our|the) video)\b"
)
META_LINE = r"^(published|updated|last updated|posted)(\s+(on|at|by|in)\b.*)?$"
CUT_HEADING = (
    r"^\s*#*\s*(\**)?(related( articles| stories| coverage| posts)?|more (for you|from|stories|on|in)|recommended( for you)?|you may also like|read (more|next)|also read|"
    r"what to read next|trending( now)?|most (read|popular)|top (picks|stories)|sponsored( content)?|popular (in|on|stories)|latest (news|stories)|up next|next up|"
    r"from our partners|further reading|see also|in other news|around the web|more news|newsletter sign.?up|share this (article|story)|about the author|comments)\b"
)
#: Exact case.
TICKER = r"(?m)^[A-Z]{2,6}[▲▼]"
WORDLESS = r"^[^\p{L}_]*$"

# -- fixed values: risky claims, phrases that only look so, and words that name nobody --------------------------------------------------

RISKS = [
    ("weapons or military use",
     r"weaponi[sz](?:e|es|ed|ing|ation)|bioweapons?|chemical weapons?|nuclear weapons?|autonomous weapons?|missiles?|ballistic|warheads?|munitions?|bombs?|bombing|explosives?|"
     r"drone strikes?|air ?strikes?|warfare|military (?:use|uses|targeting|operations?|applications?|purposes)|lethal|militants?|terror(?:ism|ist|ists)|houthis?|hamas|hezbollah"),
    ("surveillance or spying",
     r"surveil(?:s|led|ling|lance)?|spy|spies|spied|spying|spyware|stalkerware|eavesdrop(?:s|ped|ping)?|wiretap(?:s|ped|ping)?|"
     r"(?:monitor|track)(?:s|ed|ing)? (?:its |their |ai )?(?:critics|journalists|activists|dissidents|protesters|employees)"),
    ("hacking or data breach",
     r"hack(?:s|ed)?|hacking|hackers?|breach(?:es|ed)?|data leaks?|leaked (?:data|documents?|emails?|memos?|messages|records|files|chats?|conversations)|cyber-? ?attacks?|"
     r"ransomware|malware|phishing|stole|stolen|steal(?:s|ing)?|theft|exfiltrat(?:e|es|ed|ing|ion)"),
    ("fraud",
     r"fraud(?:s|ulent|ulently|ster|sters)?|scam(?:s|med|mer|mers|ming)?|embezzl(?:e|es|ed|ing|ement)|brib(?:e|es|ed|ery|ing)|launder(?:s|ed|ing)?|ponzi|insider trading|"
     r"defraud(?:s|ed|ing)?|misled investors"),
    ("lawsuit, arrest or charges",
     r"lawsuits?|sue|sues|sued|suing|class[- ]action|indict(?:s|ed|ment|ments)?|charged with|criminal charges|charges against|arrest(?:s|ed|ing)?|convicted|conviction|sentenced|"
     r"pleads? guilty|pleaded guilty|found guilty|prosecut(?:e|es|ed|ing|ion|ors?)|subpoena(?:s|ed)?|fined|raided|"
     r"(?:antitrust|criminal|federal|regulatory|ftc|sec|doj|fbi) (?:probe|probes|investigation|investigations)"),
    ("violence, abuse or harassment",
     r"murder(?:s|ed|ing)?|killed|killings?|assault(?:s|ed|ing)?|violence|violent|shootings?|abuse|abuses|abused|abusive|harass(?:es|ed|ing|ment)|sexual misconduct|"
     r"stalk(?:s|ed|ing)|child sexual|csam|non-?consensual|sextortion|suicide|self-harm"),
    ("allegation of wrongdoing",
     r"accus(?:e|es|ed|ing|ation|ations)|alleg(?:e|es|ed|edly|ing|ation|ations)|whistle-?blowers?|cover-?ups?|covered up|misconduct|scandals?|illegal|illegally|unlawful(?:ly)?|"
     r"violat(?:e|es|ed|ing|ion|ions)|without (?:consent|permission|telling)|lied|lying|deceiv(?:e|es|ed|ing)|deceptive|manipulated|cheated|wrongdoing|"
     r"exploit(?:s|ed|ing)? (?:users|workers|children|minors)"),
]
BENIGN = (
    r"\bhacker news\b|\breward hack(?:s|ing)?\b|\bhackathons?\b|\bgrowth hack(?:s|ing)?\b|\blife ?hacks?\b|\bspy ?glass\b|\bbreach(?:es)? of contract\b|"
    r"\banti-? ?money[- ]laundering\b|\bfraud (?:detection|prevention)\b"
)
NOT_NAMES = """a an the ai new how why what when who this these that study report reports research researchers scientists experts police hackers users startups startup
    companies governments government officials lawmakers regulators court judge us uk eu un llm llms gpu gpus chatbot chatbots is are in on for with after as inside exclusive
    update breaking opinion analysis watch i we they it""".split()
#: Exact case; the word is group 2.
NAME_WORD = r"(^|[^\p{L}\p{N}_$€£])([A-Za-z][A-Za-z0-9'’.&-]*)"

# -- fixed values: deals ----------------------------------------------------------------------------------------------------------------

NO_COMPANY = ["", "unknown", "none", "n/a", "null", "undisclosed"]
FUNDING = (
    r"\b(?:rais(?:e|es|ed|ing)|secur(?:e|es|ed|ing)|clos(?:e|es|ed|ing)|land(?:s|ed)|nab(?:s|bed)|bag(?:s|ged)|nets?|funding|fundrais(?:e|es|ed|ing)|financing|investment|"
    r"invest(?:s|ed|ing)|investors?|valuation|valued|valuable|worth|round|series [a-f]\b|seed|backs|backed|backing|acqui(?:res?|red|ring|sition)|buys?|bought|to buy|"
    r"purchas(?:e|es|ed)|takeover|snaps up|merger|merges?|ipo|goes public|go public|files to list|debt|led by|unicorn|stake|in talks|term sheet|capital)\b"
)
ACQUISITION = r"\b(?:acqui(?:re|res|red|ring|sition)|buys|bought|to buy|purchas(?:e|es|ed)|takeover|snaps up|merger|merges?|deal to (?:buy|acquire))\b"
LAUNCH = (
    r"\b(?:launch(?:es|ed)?|unveil(?:s|ed)?|introduc(?:e|es|ed)|debut(?:s|ed)?|releas(?:e|es|ed)|roll(?:s|ed)? out|ships?|shipped|partner(?:s|ed|ship)?|deploy(?:s|ed)|opens?|hires?|"
    r"appoints?|reviews?|hands-on|expands?|updates?|adds|announc(?:e|es|ed)|now available|available)\b"
)
#: The year is group 1.
PAST_YEAR_DEAL = (
    r"\b(?:rais(?:ed|ing)|acquired|bought|closed|secured|valued|funding|round|investment|deal)\b[^.\n]{0,80}?\b(?:in|back in|during|since|from)\s+((?:19|20)\d{2})\b"
)
LAST_YEAR = r"\b(?:last|previous) year\b"
SPECULATIVE = (
    r"\b(?:consider(?:s|ing)?|weigh(?:s|ing)?|mull(?:s|ing)?|eye(?:s|ing)|plan(?:s|ning)? to|potential|possible|in talks|talks to|seek(?:s|ing)|could|may|might|reportedly|"
    r"rumou?r(?:s|ed)?|expected to|aims? to|looking to|ahead of|would|delay(?:s|ed)?|postpone(?:s|d)?|shelve(?:s|d)?)\b"
)
IPO = r"\b(?:ipo|goes public|go public|went public|listing|lists? on|files to list|debut(?:s|ed)? on)\b"
#: Currency, number, scale and currency name are groups 1 to 4.
MONEY = (
    r"(?:([$€£]|us\$|usd|eur|gbp)\s*)?(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(trillion|billion|million|thousand|tn|bn|mn|[tbmk])?\b(?:\s*(dollars|euros|pounds|usd|eur|gbp))?"
)
SCALES = {"trillion": 1e12, "tn": 1e12, "t": 1e12, "billion": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6, "thousand": 1e3, "k": 1e3}
RATES = {"€": 1.15, "eur": 1.15, "euros": 1.15, "£": 1.3, "gbp": 1.3, "pounds": 1.3}
#: Largest plausible amount; relative tolerance of equal amounts; days that an article may be from its story.
MOST_AMOUNT, TOLERANCE, STORY_DAYS = 200e9, 0.25, 10

# -- fixed values: headlines and plain words --------------------------------------------------------------------------------------------

LEAST_HEADLINE, LEAST_HEADLINE_WORDS = 12, 3
QUESTION_WORDS = """who what when where why how which whose whom is are was were do does did can could will would should shall may might has have had must isn't aren't won't can't
    doesn't don't didn't wasn't shouldn't wouldn't couldn't am""".split()
OPINION = r"^(opinion|analysis|explainer|review|interview|podcast)\s*:\s*"
VERBS = """draft reply turn get find book answer write plan track send make resize schedule summarise summarize check create fix save sell collect organise organize translate edit post
    build run cut spot keep follow stop handle prepare add ask automate call catch clean compare confirm convert design fill grow hire improve launch manage match measure move open pay
    personalise personalize pick pitch polish promote publish reach reduce remind remove repurpose research respond reuse review rewrite see set share show sort speed split start test
    thank transcribe update upload use welcome win scan read shoot film animate adjust crop sketch draw block protect avoid control connect sync import export merge boost lower raise
    earn spend learn teach explain tell give help let try view take look greet pull rank outline generate increase evaluate select define reserve apply expand refine gather produce
    deliver attract engage drive audit activate route fetch compose remember store clear chase invite notify discover identify detect verify prevent recover retouch dub
    narrate""".split()
SWAPS = [
    (r"\blarge language models\b", "AI models"), (r"\blarge language model\b", "AI model"), (r"\bllms\b", "AI models"), (r"\bllm\b", "AI model"),
    (r"\bapi integrations\b", "connections to other apps"), (r"\bapi integration\b", "connection to other apps"),
    (r"\bintegrates (?:directly |natively )?with\b", "works with"), (r"\bintegrate (?:directly |natively )?with\b", "work with"),
    (r"\bintegrations with\b", "connections to"), (r"\bintegration with\b", "connection to"), (r"\bintegrations\b", "connections"), (r"\bintegration\b", "connection"),
    (r"\bfinal[- ]urls?\b", "final web address"), (r"\bURLs\b", "web addresses"), (r"\bURL\b", "web address"), (r"\bworkflows\b", "routines"), (r"\bworkflow\b", "routine"),
    (r"\bleverages\b", "uses"), (r"\bleveraging\b", "using"), (r"\bleverage\b", "use"), (r"\butili[sz]es\b", "uses"), (r"\butili[sz]ing\b", "using"), (r"\butili[sz]e\b", "use"),
    (r"\bstreamlines\b", "simplifies"), (r"\bstreamlining\b", "simplifying"), (r"\bstreamlined\b", "simpler"), (r"\bstreamline\b", "simplify"),
    (r"\bseamlessly\s+", ""), (r"\bseamless\s+", ""), (r"\beffortlessly\s+", ""), (r"\beffortless\s+", ""), (r"\bpowerful\s+", ""), (r"\brobust\s+", ""), (r"\bcutting[- ]edge\s+", ""),
    (r"\bsupercharges\b", "boosts"), (r"\bsupercharge\b", "boost"), (r"\bempowers (\w+) to\b", r"lets \1"), (r"\bempower (\w+) to\b", r"let \1"),
    (r"\benables (\w+) to\b", r"lets \1"), (r"\benable (\w+) to\b", r"let \1"), (r"\ballows (\w+) to\b", r"lets \1"), (r"\ballow (\w+) to\b", r"let \1"),
    (r"\bdeploys\b", "sets up"), (r"\bdeploying\b", "setting up"), (r"\bdeployed\b", "set up"), (r"\bdeploy\b", "set up"), (r"\bdeployment\b", "setup"),
    (r"\bagentic ai\b", "AI agents"), (r"\bagentic\b", "automated"), (r"\bhallucinates\b", "makes things up"), (r"\bhallucinate\b", "make things up"),
    (r"\bhallucinations\b", "made-up answers"), (r"\bhallucination\b", "a made-up answer"), (r"\buse[- ]cases\b", "uses"), (r"\buse[- ]case\b", "use"),
    (r"\bfunctionalities\b", "features"), (r"\bfunctionality\b", "features"), (r"\bfacilitates\b", "helps with"), (r"\bfacilitate\b", "help with"),
    (r"\boptimal\b", "best"), (r"\bin order to\b", "to"), (r"\bcapabilities\b", "features"), (r"\bAI[- ]powered\s+", ""), (r"\bAI[- ]driven\s+", ""),
]
JARGON = (
    r"\b(?:llms?|large language models?|agentic|workflows?|apis?|integrations?|leverag\w*|streamlin\w*|orchestrat\w*|multi-?modal|inference|fine[- ]?tun\w*|rag|sdks?|deploy\w*|"
    r"seamless\w*|unlock\w*|empower\w*|supercharg\w*|revolutioni[sz]\w*|game[- ]?chang\w*|powerful|effortless\w*|ai[- ]powered|ai[- ]driven|utili[sz]\w*|robust|cutting[- ]edge|"
    r"synerg\w*|next[- ]level|best[- ]in[- ]class|paradigm\w*|generative ai|genai|10x|holistic|scalab\w*|end[- ]to[- ]end|frictionless|turnkey|optimi[sz]ations?|mcp|embeddings?|"
    r"vector|endpoints?|tokens?|context window|hallucinat\w*|use[- ]cases?|functionalit(?:y|ies)|facilitat\w*|actionable|granular|ecosystem|omnichannel|bleeding[- ]edge|"
    r"state[- ]of[- ]the[- ]art|world[- ]class|harness\w*)\b"
)
#: Words that end no phrase because something must follow, and words before which a phrase may end.
BOUNDARY = "by and with from for to in on via through using so that which without while rather as into across within at or then when if".split()
TRAIL = [*BOUNDARY, *"a an the your their its of every each all any more new".split()]
CONDESCENDING = r"\b(?:don'?t worry|no need to worry|simply|obviously|of course|even you|easy peasy|anyone can)\b|!"
PLAIN_STOP = """a an the and or but of to in on for with from by at as is are be it its this that your you yours their them they can will get gets lets let into out up more less one
    all any every each so than then""".split()


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?i){pattern}"))


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}")


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def relevance(title: Column, text: Column) -> Column:
    """Weighted subject hits: three for each of the title's, and the body's for every 200 words."""
    title, body = F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, RELEVANCE_BODY)
    some = "|".join(f"(?:{p})" for p, _ in RELEVANCE)

    def total(t: Column) -> Column:
        """One look for any subject spares most texts the fifty counts."""
        hits = sum((w * count(t, p) for p, w in RELEVANCE[1:]), RELEVANCE[0][1] * count(t, RELEVANCE[0][0]))
        return F.when(has(t, some), hits).otherwise(0)

    return 3.0 * total(title) + 200.0 * total(body) / F.greatest(F.lit(1), T.word_count(body))


def teaser_reason(text: Column, feed_words: Column | None = None) -> Column:
    """Why a text is a subscription pitch and no article; else null."""
    text = F.coalesce(text, F.lit(""))
    words = T.word_count(text)
    hits = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?i){TEASER}"), F.lit(0)), F.lower)))
    pitch = (F.size(hits) >= 2) | ((F.size(hits) > 0) & has(text, STRONG_TEASER))
    said = (
        F.when(words < TEASER_FLOOR, F.concat(F.lit("too short to be an article ("), words.cast("string"), F.lit(" words)")))
        .when((words <= TEASER_MOST) & pitch, F.concat(F.lit("paywall teaser ("), F.get(hits, F.lit(0)), F.lit(")")))
    )
    if feed_words is None:
        return said
    short = (words <= TEASER_MOST) & (feed_words >= TEASER_FLOOR) & (words < TEASER_SHARE * feed_words)
    return said.when(short, F.concat(F.lit("far shorter than the feed's copy ("), words.cast("string"), F.lit(" of "), feed_words.cast("string"), F.lit(" words)")))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n[ \t\n\x0B\f\r]*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def bare(paragraph: Column) -> Column:
    """A paragraph without the marks in front."""
    return F.regexp_replace(F.regexp_replace(paragraph, r"^[#>* \-]+", ""), r"^\s+|\s+$", "")


def scrub(text: Column) -> Column:
    """Paragraphs of article text: up to a heading of what follows an article, past two fifths of it; without notices, lone dates, tickers and
    marks; without short ones at the end."""
    for code, mark in (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(mark))

    def judged(p: Column) -> Column:
        """A paragraph with its words and itself without the marks in front; what only short ones can be is asked of short ones."""
        plain = bare(p)
        return F.struct(p.alias("p"), plain.alias("plain"), F.regexp_count(plain, F.lit(r"\S+")).alias("n"))

    def cut(parts: Column) -> Column:
        at = F.transform(parts, lambda x, i: F.when((i > F.size(parts) * 0.4) & (x["n"] <= 6), F.when(has(x["plain"], CUT_HEADING), i)))
        return F.slice(parts, F.lit(1), F.coalesce(F.get(F.array_compact(at), F.lit(0)), F.size(parts)))

    def stays(x: Column) -> Column:
        p, plain, n = x["p"], x["plain"], x["n"]
        short = F.when(n < 45, ((n < 40) & has(plain, DROPPED)) | has(plain, INBOX) | ((n < 8) & has(plain, META_LINE))).otherwise(F.lit(False))
        marks = F.when((n <= 3) & ~p.startswith("#"), F.replace(plain, F.lit("'"), F.lit("")).rlike(WORDLESS)).otherwise(F.lit(False))
        ticker = F.when(p.contains("▲") | p.contains("▼"), p.rlike(TICKER)).otherwise(F.lit(False))
        return ~(short | ticker | marks)

    def ended_by_words(kept: Column) -> Column:
        last = F.array_max(F.transform(kept, lambda x, i: F.when(F.regexp_count(F.regexp_replace(x["p"], r"^[#>* \-]+", ""), F.lit(r"\S+")) > 4, i + 1).otherwise(0)))
        return F.array_join(F.transform(F.slice(kept, F.lit(1), F.coalesce(last, F.lit(0))), lambda x: x["p"]), "\n\n")

    # each list is computed once: an expression used inside a lambda is computed again for every element
    return let(let(let(F.transform(paragraphs(text), judged), cut), lambda parts: F.filter(parts, stays)), ended_by_words)


def risks(text: Column) -> Column:
    """array<struct<label, term>>: risky words by category, each once, under the first category that knows it."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?i){BENIGN}", " ")

    def of(label: str, pattern: str) -> Column:
        terms = F.array_distinct(F.transform(F.regexp_extract_all(clean, F.lit(rf"(?i)\b(?:{pattern})\b"), F.lit(0)), F.lower))
        return F.transform(terms, lambda t: F.struct(F.lit(label).alias("label"), t.alias("term")))

    def first_ones(every: Column) -> Column:
        return let(F.transform(every, lambda x: x["term"]), lambda terms: F.filter(every, lambda x, i: F.array_position(terms, x["term"]) == i + 1))

    found = let(F.concat(*[of(label, pattern) for label, pattern in RISKS]), first_ones)
    none = F.array().cast("array<struct<label: string, term: string>>")
    return F.when(has(clean, "|".join(rf"\b(?:{pattern})\b" for _, pattern in RISKS)), found).otherwise(none)


def names_someone(headline: Column) -> Column:
    """Whether a word with a capital isn't one that names nobody."""
    words = F.regexp_extract_all(F.coalesce(headline, F.lit("")), F.lit(NAME_WORD), F.lit(2))
    cores = F.transform(words, lambda w: F.regexp_extract(F.regexp_replace(w, "^['’.-]+|['’.-]+$", ""), "^[^'’]*", 0))
    return F.exists(cores, lambda w: (w != "") & ~F.lower(w).isin(NOT_NAMES) & w.rlike("[A-Z]"))


def hold_reason(headline: Column, lede: Column, publishers: Column) -> Column:
    """Why a story must wait for approval: one publisher, someone named, and a risky word in the headline or two in the lede."""
    def said(hits: Column, where: str) -> Column:
        labels = F.array_join(F.slice(F.array_distinct(F.transform(hits, lambda x: x["label"])), 1, 2), " and ")
        terms = F.array_join(F.transform(F.slice(hits, 1, 4), lambda x: F.concat(F.lit('"'), x["term"], F.lit('"'))), ", ")
        return F.concat(F.lit(f"Single source; {where} mentions "), labels, F.lit(" ("), terms, F.lit(")"))

    def of_both(x: Column) -> Column:
        in_head = F.transform(x["head"], lambda y: y["term"])
        body = let(in_head, lambda known: F.filter(x["lede"], lambda y: ~F.array_contains(known, y["term"])))
        return F.when(F.size(x["head"]) > 0, said(x["head"], "headline")).otherwise(let(body, lambda y: F.when(F.size(y) >= 2, said(y, "summary"))))

    hits = let(F.struct(risks(headline).alias("head"), risks(lede).alias("lede")), of_both)
    return F.when((publishers <= 1) & names_someone(headline), hits)


def money(text: Column) -> Column:
    """array<double>: amounts in dollars; one in another currency also as it stands. Numbers without a currency or a scale word are none."""
    text = F.coalesce(text, F.lit(""))
    parts = [F.regexp_extract_all(text, F.lit(f"(?i){MONEY}"), F.lit(i)) for i in (1, 2, 3, 4)]
    found = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("c", "n", "u", "d"), strict=True)]), lambda x: F.struct(
        F.lower(F.when(x["c"] != "", x["c"]).otherwise(F.coalesce(x["d"], F.lit("")))).alias("currency"), F.lower(F.coalesce(x["u"], F.lit(""))).alias("unit"), F.replace(x["n"], F.lit(","), F.lit("")).cast("double").alias("n")))
    real = F.filter(found, lambda x: ~((x["currency"] == "") & x["unit"].isin("", "t", "b", "m", "k")))
    look = lambda table, key: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key), F.lit(1.0))
    amounts = F.transform(real, lambda x: F.struct((x["n"] * look(SCALES, x["unit"])).alias("v"), look(RATES, x["currency"]).alias("r")))
    return F.flatten(F.transform(amounts, lambda x: F.when(x["r"] == 1.0, F.array(x["v"])).otherwise(F.array(x["v"] * x["r"], x["v"]))))


def close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) <= tolerance * F.greatest(a, b)), F.lit(False))


def past_year(text: Column, year: int) -> Column:
    return has(text, LAST_YEAR) | F.exists(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?i){PAST_YEAR_DEAL}"), F.lit(1)), lambda y: y.cast("int") < year)


def deal_problem(company: Column, kind: Column, amount: Column, valuation: Column, headline: Column, text: Column, article_at: Column, story_at: Column, year: int) -> Column:
    """Why a claimed deal is none, by the first rule that fails; null for a deal."""
    name = F.lower(F.trim(F.coalesce(company, F.lit(""))))
    kind = F.lower(F.trim(F.coalesce(kind, F.lit("other"))))
    words = F.filter(F.regexp_extract_all(name, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin("inc", "ltd", "the", "labs"))
    head, text = F.coalesce(headline, F.lit("")), F.coalesce(text, F.lit(""))
    begun = F.regexp_extract_all(F.lower(head), F.lit("[a-z0-9]+"), F.lit(0))
    named = F.exists(words, lambda w: F.exists(begun, lambda b: F.startswith(b, w)))
    funding_head, both = has(head, FUNDING), F.concat(head, F.lit("\n"), text)
    return (
        F.when(name.isin(NO_COMPANY) | ~name.rlike("[a-z0-9]"), "no company")
        .when((F.size(words) > 0) & ~named, "company not named in the headline")
        .when(has(head, SPECULATIVE), "not a done deal")
        .when((kind == "ipo") & ~has(head, IPO), "called an IPO, but the headline does not say so")
        .when(~funding_head & has(head, LAUNCH), "headline is about a product, not a deal")
        .when(~funding_head & ~has(text, FUNDING), "nothing about a deal in the text")
        .when((kind == "acquisition") & ~has(head, ACQUISITION), "called an acquisition, but the headline does not say so")
        .when(amount.isNotNull() & ~((amount > 0) & (amount <= MOST_AMOUNT)), "implausible amount")
        .when(amount.isNotNull() & ~F.exists(money(F.concat(head, F.lit(" "), text)), lambda v: close(amount, v)), "amount not in the article's text")
        .when((amount >= 0.8 * valuation) & (kind != "acquisition"), "amount is the valuation")
        .when(F.abs(F.datediff(article_at, story_at)) > STORY_DAYS, "article is not from the story's time")
        .when(past_year(both, year), "a deal from an earlier year")
    )


def occurrences(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def usable_headline(headline: Column) -> Column:
    """Long enough, with clean ends and balanced brackets and quotes."""
    t = F.regexp_replace(F.coalesce(headline, F.lit("")), r"^\s+|\s+$", "")
    balanced = (occurrences(t, "(") == occurrences(t, ")")) & (occurrences(t, "[") == occurrences(t, "]")) & (occurrences(t, '"') % 2 == 0) & (occurrences(t, "“") == occurrences(t, "”"))
    ends = t.rlike(r"^[\p{L}\p{N}_\"“‘'(\[$£€]") & ~t.rlike(r"[,;:\-–—(\[|]$")
    return (F.length(t) >= LEAST_HEADLINE) & (T.word_count(t) >= LEAST_HEADLINE_WORDS) & t.rlike("[A-Za-z]") & ends & balanced


def real_question(headline: Column) -> Column:
    """Whether the whole or a clause of it begins like a question."""
    body = F.regexp_replace(F.trim(headline), f"(?i){OPINION}", "")
    first = F.transform(F.concat(F.array(body), F.split(body, r"[:;—–]|\s-\s|,")), lambda x: F.replace(F.lower(F.regexp_extract(F.regexp_replace(F.trim(x), r"^[\"“‘'(\[]+", ""), r"^\S+", 0)), F.lit("’"), F.lit("'")))
    return F.exists(first, lambda w: w.isin(QUESTION_WORDS))


def verb_base(word: Column) -> Column:
    """The verb of the list that a word is a form of, else null."""
    w = F.regexp_replace(F.lower(F.coalesce(word, F.lit(""))), "[^a-z]", "")
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    stem = cut(3)
    ing = w.endswith("ing")
    double = ing & (F.length(stem) > 2) & (F.substring(stem, -1, 1) == F.substring(stem, -2, 1))
    forms = F.array(w, F.when(w.endswith("ies"), F.concat(cut(3), F.lit("y"))), F.when(w.endswith("es"), cut(2)), F.when(w.endswith("s"), cut(1)), F.when(ing, stem), F.when(ing, F.concat(stem, F.lit("e"))), F.when(double, cut(4)))
    return F.get(F.filter(forms, lambda f: f.isin(VERBS)), F.lit(0))


def imperative(text: Column) -> Column:
    """A phrase that begins with a form of a listed verb, as an order; else null."""
    t = squash(text)
    base = verb_base(F.split_part(t, F.lit(" "), F.lit(1)))
    return F.concat(F.initcap(base), F.regexp_extract(t, r"^\S+(.*)$", 1))


def plain_dashes(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[‐-―−]", "-")


#: For each swap a piece of a word that all it fits holds in small letters. No swap's words hold one, so a text that lacks it at first never gets it.
_STEMS = ["language", "llm", "integrat", "url", "workflow", "leverag", "utili", "streamlin", "seamless", "effortless", "powerful", "robust", "cutting", "supercharg", "empower", "enable", "allow",
          "deploy", "agentic", "hallucinat", "case", "functionalit", "facilitat", "optimal", "order", "capabilit", "powered", "driven"]


def _stem(pattern: str) -> str:
    return next(x for x in _STEMS if x in pattern.lower())


def swap_jargon(text: Column) -> Column:
    """The plain word where one says the same, with the article before it set right."""
    def swapped(x: Column) -> Column:
        """Swaps are looked for only where the text has their stem: most texts have few."""
        t = x["t"]
        for stem, group in itertools.groupby(SWAPS, lambda swap: _stem(swap[0])):
            t = let(t, where_stem(x["small"].contains(stem), list(group)))
        return t

    def where_stem(there: Column, swaps: list[tuple[str, str]]):
        def swap(t: Column) -> Column:
            done = t
            for pattern, plain in swaps:
                done = F.regexp_replace(done, f"(?i){pattern}", plain.replace("\\1", "$1"))
            return F.when(there, done).otherwise(t)
        return swap

    t = let(plain_dashes(squash(text)), lambda t: F.struct(t.alias("t"), F.lower(t).alias("small")))
    t = let(t, swapped)
    t = F.regexp_replace(t, r"\b([Aa])n (routine|connection|simpl\w*|set up|boost|let|made|help|best|features?|uses?|web)\b", "$1 $2")
    t = F.regexp_replace(t, r"\b([Aa]) (AI\b)", "$1n $2")
    return squash(t)


def jargon(text: Column) -> Column:
    return F.regexp_extract_all(plain_dashes(text), F.lit(f"(?i){JARGON}"), F.lit(0))


def plain_enough(text: Column) -> Column:
    return (F.size(jargon(text)) == 0) & ~has(text, CONDESCENDING)


def plain_words(text: Column) -> Column:
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(PLAIN_STOP))
    return F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, "(ing|ed|es|s)$", "")))


def overlap(a: Column, b: Column) -> Column:
    """Share of the shorter text's words that the other has; 0 where one has none."""
    x, y = plain_words(a), plain_words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))), F.lit(0.0))


def phrase_prefixes(text: Column, most_words: int, most_chars: int | None = None) -> Column:
    """Leading parts of a phrase, longest first, that end where a phrase can: before a joining word, not on one, not at a comma, and not within
    three words of one."""
    fits = lambda line: F.lit(True) if most_chars is None else F.length(line) <= most_chars

    def of(x: Column) -> Column:
        t, words, n = x["t"], x["words"], x["n"]
        whole = F.when((n <= most_words) & fits(t) & (t != ""), F.array(t)).otherwise(F.array().cast("array<string>"))
        sizes = F.filter(F.sequence(F.lit(most_words), F.lit(2)), lambda k: k < n)

        def part(k: Column) -> Column:
            head = F.slice(words, F.lit(1), k)
            line, last, after = F.array_join(head, " "), F.element_at(head, -1), F.element_at(words, k + 1)
            commas = F.filter(F.transform(head, lambda w, i: F.when(w.endswith(",") & (i < k - 1), i)), lambda i: i.isNotNull())
            stub = (F.size(commas) > 0) & (k - 1 - F.array_max(commas) < 3)
            good = F.regexp_replace(F.lower(after), "^,+|,+$", "").isin(BOUNDARY) & ~last.endswith(",") & ~F.lower(last).isin(TRAIL) & ~F.coalesce(stub, F.lit(False)) & fits(line)
            return F.when(good, line)

        return F.concat(whole, F.filter(F.transform(sizes, part), lambda x: x.isNotNull()))

    # the text is cut into words once, and only those that a part can have are kept
    cut = lambda t: let(F.split(t, " "), lambda w: F.struct(t.alias("t"), F.slice(w, 1, most_words + 1).alias("words"), F.size(w).alias("n")))
    return let(let(F.regexp_replace(squash(text), r"\.+$", ""), cut), of)


def cut_phrase(text: Column, most_words: int, most_chars: int | None = None) -> Column:
    return F.coalesce(F.get(phrase_prefixes(text, most_words, most_chars), F.lit(0)), F.lit(""))


# -- fixed values: hype, bait and shouting in headlines ---------------------------------------------------------------------------------

HYPE = [
    (r"revolutioni[sz]es", "changes"), (r"revolutioni[sz]ing", "changing"), (r"revolutioni[sz]ed", "changed"), (r"revolutioni[sz]e", "change"), (r"unleashes", "releases"),
    (r"unleashing", "releasing"), (r"unleashed", "released"), (r"unleash", "release"), (r"game[- ]?changers", "major shifts"), (r"game[- ]?changer", "major shift"),
]
HYPE_ADJECTIVES = r"(?:game[- ]?changing|revolutionary|groundbreaking|ground-breaking|mind-blowing|jaw-dropping|earth-shattering|mind-bending)"
BAIT = [
    (r"^(?:breaking(?: news)?|just in|exclusive|urgent|must read)\s*[:|\-–—]\s*", ""),
    (r"^you won[’']?t believe\s+", ""),
    (r"[\s,;:.\-–—]*\b(?:and )?you won[’']?t believe\b.*$", ""),
    (r"^everything you need to know about\s+", "What we know about "),
    (r"[\s,;:.\-–—(]*\b(?:here[’']?s |here is )?(?:everything|all|what) you need to know(?: about (?:it|this|that|them))?[)\s.!]*$", ""),
    (r"^everything you need to know\s*[:\-–—]\s*", ""),
    (r"^here[’']?s (why|how|what)\s+", r"$1 "),
    (r"^here is (why|how|what)\s+", r"$1 "),
    (r"\s*(?:[,;:.–—(]|\s-)\s*(?:and |but )?(?:here[’']?s|here is|this is) (?:why|how|what)\b[^.?!]{0,40}[).?!]*$", ""),
    (r"\s+(?:and|but) here[’']?s (?:why|how|what)\b[^.?!]{0,40}[).?!]*$", ""),
    (r"[\s,;:.\-–—]+(?:and )?(?:it |this |that )?will (?:shock|stun|surprise|amaze) you\b.*$", ""),
    (r"[\s,;:.\-–—]+(?:and )?(?:it[’']?s|this is) (?:huge|insane|wild|crazy)\b[.!]*$", ""),
]
ACRONYMS = "NVIDIA NASDAQ UNESCO UNICEF FEDRAMP SPARQL FORTRAN OPENCV SCOTUS POTUS FLOTUS ARPANET CAPTCHA ERCOT".split()
SHOUTS = """BREAKING HUGE NEW FREE WOW OMG MUST NEVER EVER BIG NOW JUST BEST WORST SHOCKING EXCLUSIVE URGENT MASSIVE INSANE CRAZY AMAZING WARNING ALERT STOP REALLY VERY THIS THAT NOT
    YOU YOUR EVERYTHING SECRET TRUTH INCREDIBLE EPIC WILD FINALLY OFFICIAL OFFICIALLY LIVE""".split()
ALWAYS_UPPER = """ai agi api apis gpu gpus cpu llm llms us uk eu ceo cto cfo ipo hls rtl sdk saas seo crm nlp rag tpu tpus nasa fda ftc sec doj gdpr hr it ui ux vr ar pc iot ml gb tb
    mcp url urls""".split()
#: Upper case only where the source's title writes them so.
UPPER_OR_WORD = ["us", "it"]
KNOWN_SPELLINGS = "OpenAI ChatGPT DeepMind DeepSeek GitHub YouTube LinkedIn TikTok WhatsApp Nvidia Anthropic iPhone iPad macOS iOS Mac MacBook xAI GPT".split()
COMMON_FIRST = """a an the this that these those it its is are was were be will would can could should may might must do does did has have had how why what when where who which whose while
    if as at by for from in into of on onto to with without about after before over under new more most less all any some every each no not our your their my his her we you they i here
    there study report researchers says said just only why inside""".split()

WORD = r"[A-Za-z][A-Za-z0-9'’.+&-]*"
_VOWEL = r"[\"“‘'(]*(?:(?-i:[AEFHILMNORSX][A-Z]{0,4})\b|hour|honest|heir|(?!uni|use|usu|eu|one|once|(?-i:[A-Z]{1,5})\b)[aeiou])"


def title_case_heavy(text: Column) -> Column:
    """Whether most words after the first begin with a capital."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z][a-z’']{3,}"), F.lit(0))
    return let(words, lambda w: (F.size(w) > 0) & (F.size(F.filter(F.slice(w, F.lit(2), F.size(w)), lambda x: x.rlike("^[A-Z]"))) >= F.greatest(F.lit(1.0), (F.size(w) - 1) * 0.6)))


def tidy(text: Column) -> Column:
    t = squash(text)
    t = F.regexp_replace(t, r"\s+([,;:.!?])", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"^[\s,;:.\-–—|]+", ""), r"[\s,;:\-–—|(]+$", "")
    return let(t, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000)))


def _calmed(text: Column) -> Column:
    """Words in capitals that are no acronyms in lower case."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_’'-]+|[^\p{L}\p{N}_’'-]+"), F.lit(0))

    def one(p: Column, i: Column, heavy: Column) -> Column:
        plain = F.translate(p, "’'", "")
        loud = p.rlike("^[A-Z][A-Z’']{2,}$") & ~plain.isin(ACRONYMS) & (plain.isin(SHOUTS) | (F.length(plain) >= 6))
        first = (i == 0) | heavy
        return F.when(loud & first, F.concat(F.substring(p, 1, 1), F.lower(F.substring(p, 2, 1_000_000)))).when(loud, F.lower(p)).otherwise(p)

    return let(F.struct(pieces.alias("p"), title_case_heavy(text).alias("heavy")), lambda x: F.array_join(F.transform(x["p"], lambda p, i: one(p, i, x["heavy"])), ""))


def _one_colon(text: Column) -> Column:
    """Colons after the first as dashes; a label such as "Opinion:" and times don't count."""
    label = F.regexp_extract(text, f"(?i){OPINION}", 0)
    parts = F.split(F.regexp_replace(text, f"(?i){OPINION}", ""), r"(?<![0-9]):|:(?![0-9])")

    def joined(p: Column) -> Column:
        rest = F.slice(p, F.lit(2), F.size(p))
        rest = F.transform(rest, lambda x, i: F.when(i < F.size(p) - 2, F.rtrim(x)).otherwise(x))
        return F.concat(label, F.get(p, F.lit(0)), F.lit(":"), F.array_join(rest, " —"))

    return let(parts, lambda p: F.when(F.size(p) > 2, joined(p)).otherwise(text))


def headline_rules(headline: Column, hedged: Column) -> Column:
    """The headline with exclamation marks, frames, hype words, shouting and spare colons taken out, and a question mark that a statement bears,
    unless the source's title hedges. Not tidied."""
    h = F.regexp_replace(headline, r"(?i)\b(Yahoo|Jeopardy|Wham)!", "$1\u0001")
    for pattern, new in ((r"\?!+|!+\?", "?"), (r"!+(?=\s+[A-Z0-9])", "."), ("!", ""), ("\u0001", "!"), (r"\?{2,}", "?"), (r"\s*(?:\.\.\.|…)\s*$", "")):
        h = F.regexp_replace(h, pattern, new)
    for pattern, new in BAIT:
        h = F.regexp_replace(h, f"(?i){pattern}", new)
    for pattern, new in HYPE:
        h = F.regexp_replace(h, rf"\b{pattern[0].upper()}(?i:{pattern[1:]})\b", new.capitalize())
        h = F.regexp_replace(h, rf"(?i)\b{pattern}\b", new)
    h = F.regexp_replace(h, rf"(?i)\b(a)n?\s+{HYPE_ADJECTIVES}\s+(?={_VOWEL})", "$1n ")
    h = F.regexp_replace(h, rf"(?i)\b(a)n?\s+{HYPE_ADJECTIVES}\s+(?=\S)", "$1 ")
    h = F.regexp_replace(h, rf"(?i)\b{HYPE_ADJECTIVES}\s+(?=\S)", "")
    h = let(h, _calmed)
    h = let(h, _one_colon)
    asked = lambda x: F.rtrim(x).endswith("?") & ~real_question(F.rtrim(x)) & ~hedged
    return let(h, lambda x: F.when(asked(x), F.regexp_replace(x, r"\s*\?+\s*$", "")).otherwise(x))


def spellings(title: Column, names: Column) -> Column:
    """Words as the title and the names spell them, where that has capitals: names first, then the title's, then the well-known. Of a title in title
    case only words with capitals inside count, and its first word; a first word that any sentence may begin with never counts."""
    words = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(WORD), F.lit(0))

    def of_title(w: Column) -> Column:
        long = F.filter(w, lambda x: F.length(x) > 3)
        heavy = let(long, lambda y: (F.size(y) > 0) & (F.size(F.filter(y, lambda x: x.rlike("^[A-Z]"))) >= 0.6 * F.size(y)))
        kept = lambda case: F.transform(w, lambda x, i: F.when(x.rlike("^.+[A-Z]") | (x.rlike("^[A-Z]") & ~F.when(i == 0, F.lower(x).isin(COMMON_FIRST)).otherwise(case)), x))
        return F.array_compact(let(heavy, kept))

    own = F.filter(F.flatten(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.regexp_extract_all(n, F.lit(WORD), F.lit(0)))), lambda x: x.rlike("[A-Z]"))
    bare = lambda a: F.flatten(F.transform(a, lambda x: F.array(x, F.regexp_replace(x, "['’]s$", ""))))
    return F.concat(bare(own), bare(let(words, of_title)), F.array(*[F.lit(x) for x in KNOWN_SPELLINGS]))


def restore_case(headline: Column, title: Column, names: Column) -> Column:
    """Capitals put back into a headline that lacks them: where it has none at all, where its first letter is small for no reason, or where more of
    the words that title and names spell with capitals are wrong than right."""
    pieces = F.regexp_extract_all(F.trim(F.coalesce(headline, F.lit(""))), F.lit(rf"{WORD}|[^A-Za-z]+"), F.lit(0))
    title_words = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(WORD), F.lit(0))

    def form(p: Column, x: Column) -> Column:
        """How a word should be written, or null."""
        hit = F.get(x["s"], F.array_position(x["low"], F.lower(p)).cast("int") - 1)
        small = (p == F.lower(p)) & p.rlike("[a-z]")
        upper = F.lower(p).isin(ALWAYS_UPPER) & (~F.lower(p).isin(UPPER_OR_WORD) | F.array_contains(x["t"], F.upper(p)))
        raised = p.rlike("^[A-Z][^A-Z]*$") & hit.rlike("^.+[A-Z]") & (hit != F.upper(hit)) & (F.substring(p, 2, 100) != F.substring(hit, 2, 100))
        return F.when(small & hit.isNotNull() & (hit != p), hit).when(small & hit.isNull() & upper, F.upper(p)).when(raised, hit)

    def judged(x: Column) -> Column:
        """Distinct pieces that are written otherwise, with their forms, and those that are right as they are."""
        changed = F.filter(F.transform(x["d"], lambda p: F.struct(p.alias("p"), form(p, x).alias("form"))), lambda y: y["form"].isNotNull())
        right = F.filter(x["d"], lambda p: (p.rlike("[A-Z]") & F.array_contains(x["s"], p)) | (F.lower(p).isin(ALWAYS_UPPER) & (p == F.upper(p))))
        return F.struct(x["p"].alias("p"), changed["p"].alias("from"), changed["form"].alias("to"), right.alias("right"))

    def better(x: Column) -> Column:
        forms = F.transform(x["p"], lambda p: F.get(x["to"], F.array_position(x["from"], p).cast("int") - 1))
        return F.struct(x["p"].alias("p"), forms.alias("better"), F.size(F.filter(x["p"], lambda p: F.array_contains(x["right"], p))).alias("right"))

    def fixed(x: Column) -> Column:
        wrong = F.size(F.array_compact(x["better"]))
        first = F.get(x["p"], F.lit(0))
        small_first = first.rlike("^[a-z]") & ~first.rlike("^.+[A-Z]")
        whole = F.array_join(x["p"], "")
        act = ~whole.rlike("[A-Z]") | small_first | ((wrong > 0) & (wrong > x["right"]))
        out = F.array_join(F.zip_with(x["p"], x["better"], lambda p, b: F.coalesce(b, p)), "")
        begun = ~first.rlike("^.+[A-Z]") & ~F.coalesce(F.get(x["better"], F.lit(0)).rlike("^.+[A-Z]"), F.lit(False))
        out = let(out, lambda o: F.when(o.rlike("^[a-z]") & begun, F.concat(F.upper(F.substring(o, 1, 1)), F.substring(o, 2, 1_000_000))).otherwise(o))
        return F.when(act, out).otherwise(whole)

    # a title may be thousands of words: each distinct one is judged once, and lists that all words are held against are computed once
    known = F.struct(pieces.alias("p"), F.array_distinct(spellings(title, names)).alias("s"), F.array_distinct(title_words).alias("t"))
    known = let(known, lambda x: F.struct(x["p"].alias("p"), F.array_distinct(x["p"]).alias("d"), x["s"].alias("s"), F.transform(x["s"], F.lower).alias("low"), x["t"].alias("t")))
    return let(let(let(known, judged), better), fixed)


def discipline(headline: Column, title: Column, names: Column) -> Column:
    """A plain headline: capitals restored, then the rules. What the rules would break is replaced by the source's own title by the same rules, and
    where that is no headline either nothing changes."""
    title = F.trim(F.coalesce(title, F.lit("")))
    hedged = (title == "") | title_asks(title) | has(title, rf"\b(?:{SOURCE_HEDGES})\b")
    ruled = lambda h: let(headline_rules(h, hedged), lambda x: F.struct(x.alias("raw"), tidy(x).alias("text")))

    def chosen(x: Column) -> Column:
        fine = usable_headline(x["new"]["text"]) & (F.length(x["new"]["text"]) >= 0.4 * F.length(x["old"]))
        other = (title != "") & (title != x["old"]) & usable_headline(x["alt"]["text"])
        return F.when(x["new"]["raw"] == x["old"], x["old"]).when(fine, x["new"]["text"]).when(other, x["alt"]["text"]).otherwise(x["old"])

    return let(restore_case(headline, title, names), lambda h: let(F.struct(h.alias("old"), ruled(h).alias("new"), ruled(F.substring(title, 1, 160)).alias("alt")), chosen))


# -- fixed values: figures --------------------------------------------------------------------------------------------------------------

NUMBER = r"(?i)(?<![\w.])[$€£]?(\d[\d,]*(?:\.\d+)?)\s*(trillion|billion|million|thousand|tn|bn|mn|[tbmk](?![a-z])|%|percent)?(?!\w)"
WORD_NUMBERS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "twenty": 20, "thirty": 30, "forty": 40,
    "fifty": 50, "hundred": 100,
}
#: Characters of a source below which it can neither support nor contradict.
LEAST_SOURCE = 200


def numbers(text: Column) -> Column:
    """array<struct<written, value>>: figures in digits with their scale, then number words."""
    text = F.coalesce(text, F.lit(""))
    parts = [F.regexp_extract_all(text, F.lit(NUMBER), F.lit(i)) for i in (0, 1, 2)]
    scale = lambda u: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in SCALES.items() for v in kv]), F.lower(u)), F.lit(1.0))
    digits = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "wnu", strict=True)]), lambda x: F.struct(F.trim(x["w"]).alias("written"), (F.replace(x["n"], F.lit(","), F.lit("")).cast("double") * scale(x["u"])).alias("value")))
    found = [F.when(has(text, rf"\b{w}\b"), F.struct(F.lit(w).alias("written"), F.lit(float(v)).alias("value"))) for w, v in WORD_NUMBERS.items()]
    return F.concat(digits, F.array_compact(F.array(*found)))


def same_figure(a: Column, b: Column) -> Column:
    """Whether a reader takes two figures for one: large ones within a fifth; a round one for what rounds to it, within a twentieth; others if equal."""
    big = F.greatest(F.abs(a), F.abs(b))

    def rounds(r: Column, exact: Column) -> Column:
        size = F.length(r.cast("decimal(20,0)").cast("string"))
        step = F.pow(F.lit(10.0), size - F.when(r >= 100, 2).otherwise(1))
        return (r >= 10) & (r == F.bround(r, 0)) & (r % step == 0) & (F.bround(exact / step, 0) * step == r) & (F.abs(a - b) <= 0.05 * big)

    return F.when(big >= 1e6, F.abs(a - b) <= 0.2 * big).otherwise((a == b) | rounds(a, b) | rounds(b, a))


def unsupported_figures(claim: Column, source: Column) -> Column:
    """Figures in digits, years left out, that no figure of the source matches, as written."""
    held = numbers(source)
    made = F.filter(numbers(claim), lambda x: x["written"].rlike("[0-9]") & ~x["written"].rlike("^(?:19|20)[0-9]{2}$"))
    return let(held, lambda h: F.array_distinct(F.transform(F.filter(made, lambda x: ~F.exists(h, lambda y: same_figure(x["value"], y["value"]))), lambda x: x["written"])))


def flat(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def unsupported_names(names: Column, claim: Column, source: Column) -> Column:
    """Names of three characters or more that the claim uses and the source doesn't."""
    used = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: (F.length(F.trim(n)) >= 3) & F.contains(F.lower(claim), F.lower(F.trim(n))))
    return let(flat(source), lambda s: F.array_distinct(F.filter(F.transform(used, lambda n: F.trim(n)), lambda n: ~F.contains(s, flat(n)))))


def drop_sentences(text: Column, bad: Column) -> Column:
    """The text without sentences that hold one of bad, paragraph by paragraph."""
    stays = lambda s: (F.trim(s) != "") & ~F.exists(bad, lambda b: F.contains(F.lower(s), F.lower(b)))
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.array_join(F.filter(F.split(p, r"(?<=[.!?])\s+"), stays), " "))
    return F.trim(F.array_join(F.filter(parts, lambda p: p != ""), "\n\n"))


# -- plain cards ------------------------------------------------------------------------------------------------------------------------

#: Characters and words that a card's fields may have.
HEADLINE_SIZE, YOU_GET_SIZE, CATCH_SIZE, WHAT_SIZE, USES = (45, 70, 6, 11), (60, 120), (10, 80), (15, 90), (3, 6)
MOST_GRADE, MOST_SENTENCE, MOST_LONG = 8.0, 20, 0.3
GENERIC_CATCH = "Check the details on the maker's page first"


def plain_syllables(word: Column) -> Column:
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    cut = F.regexp_replace(F.regexp_replace(w, "([^laeiouy])(?:es|ed|e)$", "$1"), "^y", "")
    return F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(cut, F.lit("[aeiouy]+"))))


def plain_sentences(text: Column) -> Column:
    return F.filter(F.split(squash(text), r"(?<=[.?!])\s+(?=[A-Z0-9\"“])"), lambda s: s.rlike("[A-Za-z]"))


def readable(text: Column) -> Column:
    """Grade 8 at most, no sentence over twenty words, not many long words; a capitalised word that isn't a sentence's first is one syllable."""
    def words_of(s: Column) -> Column:
        found = F.regexp_extract_all(s, F.lit(r"[A-Za-z][A-Za-z'’-]*|[0-9][0-9,.%$€£]*"), F.lit(0))
        parts = lambda w: F.aggregate(F.split(w, "[-’']"), F.lit(0), lambda a, p: a + plain_syllables(p))
        return F.transform(found, lambda w, i: F.when(w.rlike("^[0-9]") | ((i > 0) & w.rlike("^[A-Z]")), F.lit(1)).otherwise(parts(w)))

    def judged(x: Column) -> Column:
        each, n = F.flatten(x), F.greatest(F.size(F.flatten(x)), F.lit(1))
        total = F.aggregate(each, F.lit(0), lambda a, y: a + y)
        grade = F.round(0.39 * n / F.greatest(F.size(x), F.lit(1)) + 11.8 * total / n - 15.59, 1)
        long = F.round(F.size(F.filter(each, lambda y: y >= 3)) / n, 2)
        return (F.size(each) == 0) | ((grade <= MOST_GRADE) & (F.coalesce(F.array_max(F.transform(x, F.size)), F.lit(0)) <= MOST_SENTENCE) & (long <= MOST_LONG))

    return let(F.transform(plain_sentences(text), words_of), judged)


def headline_problems(text: Column) -> Column:
    """What keeps a line from being a card's headline, in order; empty for a good one."""
    return let(squash(text), _headline_problems)


def _headline_problems(t: Column) -> Column:
    first = F.split_part(t, F.lit(" "), F.lit(1))
    n, low, high = T.word_count(t), HEADLINE_SIZE, HEADLINE_SIZE
    rest = F.slice(F.split(t, " "), F.lit(2), F.greatest(F.size(F.split(t, " ")) - 1, F.lit(0)))
    caps = F.filter(rest, lambda w: w.rlike("^[A-Z][^A-Z0-9]*$"))
    found = F.array_compact(F.array(
        F.when(~F.length(t).between(low[0], high[1]), "length"), F.when(~n.between(low[2], high[3]), "words"), F.when(~F.coalesce(F.lower(first) == verb_base(first), F.lit(False)) | ~first.rlike("^[A-Z]"), "verb first"),
        F.when(has(t, r"[?!]|\b(?:this|these|here'?s|here is|you won'?t)\b"), "teaser"), F.when(t.rlike(r"\bAI\b"), "AI"), F.when(~plain_enough(t), "jargon"),
        F.when((F.size(rest) >= 4) & (F.size(caps) > 0.5 * F.size(rest)), "title case"), F.when(~readable(t), "reading level"),
    ))
    return F.when(t == "", F.array(F.lit("empty"))).otherwise(found)


def ended(text: Column) -> Column:
    t = F.regexp_replace(text, "[ ,;:]+$", "")
    return F.when(t.rlike("[.?…]$"), t).otherwise(F.concat(t, F.lit(".")))


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))


def clauses(text: Column) -> Column:
    """A text's first sentence, then leading clauses of it."""
    first = F.regexp_replace(F.coalesce(F.get(plain_sentences(text), F.lit(0)), squash(text)), r"\.+$", "")

    def cut(s: Column) -> Column:
        opens = s.rlike(r"(?i)^(?:if|when|while|although|though|because|since|as|unless|once)\b")
        marks = [(";", False), (r"\s[—–-]\s", False), (":", False), (r",\s(?:but|so|which|while|though)\b", True), (r",\s(?=causing|making|meaning)", True), (r"\s(?:but|so|while|because|although)\s", False)]
        heads = [F.when(s.rlike(m) & ~(opens & F.lit(comma)), F.regexp_replace(F.regexp_extract(s, rf"(?s)^(.*?)(?:{m})", 1), "[ ,;:]+$", "")) for m, comma in marks]
        return F.array_distinct(F.filter(F.array(s, *heads), lambda x: x.isNotNull() & ((F.length(x) >= 8) | (x == s)) & (x != "")))

    return let(first, cut)


def plain_catch(text: Column) -> Column:
    """The catch on one plain line: the fullest candidate that fits, or one that reads easier and keeps three quarters of it; else the general one."""
    t = swap_jargon(F.regexp_replace(squash(text), "^[\"“”']+|[\"“”']+$", ""))
    every = lambda x: F.concat(F.array(x), clauses(x))
    both = lambda a: F.concat(a, F.flatten(F.transform(a, lambda o: phrase_prefixes(o, 16, CATCH_SIZE[1]))))
    good = lambda a: F.filter(F.transform(a, lambda c: capital(F.regexp_replace(c, r"\.+$", ""))), lambda c: F.length(c).between(*CATCH_SIZE) & plain_enough(c))

    def best(a: Column) -> Column:
        """Candidates are judged once each, as far as they may be asked for."""
        judged = F.transform(a, lambda c: F.struct(c.alias("c"), readable(c).alias("easy")))
        top = lambda j: F.get(j, F.lit(0))
        easier = lambda j: F.get(F.filter(j, lambda x: x["easy"] & (F.length(x["c"]) >= 0.75 * F.length(top(j)["c"]))), F.lit(0))["c"]
        return let(judged, lambda j: F.coalesce(F.when(top(j)["easy"], top(j)["c"]).otherwise(F.coalesce(easier(j), top(j)["c"])), F.lit(GENERIC_CATCH)))

    return let(good(let(let(t, every), both)), best)


def plain_what(text: Column) -> Column:
    """What a thing does on one plain line: the text, its first sentence or a clause of it; empty where none is plain and short."""
    t = swap_jargon(F.regexp_replace(squash(text), "^[\"“”']+|[\"“”']+$", ""))

    first = lambda x: F.get(x, F.lit(0))
    done = lambda x: ended(capital(x))
    whole = lambda a: F.filter(F.transform(a, done), lambda c: F.length(c).between(*WHAT_SIZE) & plain_enough(c))
    short = lambda a: F.filter(F.transform(a, lambda c: cut_phrase(c, 16, WHAT_SIZE[1] - 1)), lambda s: (F.length(s) >= WHAT_SIZE[0]) & plain_enough(s))
    judged = lambda a: F.transform(a, lambda c: F.struct(c.alias("c"), readable(c).alias("easy")))
    easy = lambda a: first(F.filter(a, lambda x: x["easy"]))["c"]

    def pick(a: Column) -> Column:
        both = F.struct(judged(whole(a)).alias("whole"), judged(short(a)).alias("short"))
        return let(both, lambda x: F.coalesce(easy(x["whole"]), done(easy(x["short"])), first(x["whole"])["c"], done(first(x["short"])["c"]), F.lit("")))

    return let(let(t, lambda x: F.concat(F.array(x), clauses(x))), pick)


def plain_uses(uses: Column) -> Column:
    """At most three uses of six words at most, plain, as orders where they begin with a listed verb."""
    short = F.transform(uses, lambda u: let(swap_jargon(F.regexp_replace(squash(u), r"\.+$", "")), lambda x: capital(cut_phrase(F.coalesce(imperative(x), x), USES[1]))))
    good = F.filter(short, lambda s: (s != "") & plain_enough(s))
    return let(good, lambda g: F.slice(F.filter(g, lambda s, i: F.array_position(F.transform(g, F.lower), F.lower(s)) == i + 1), 1, USES[0]))


# -- fixed values: terms that are no company or model, cards that don't belong, hedges --------------------------------------------------------

GENERIC_TERM = (
    r"^(the|a|an)\s|\b(fund|funds|capital|ventures?|partners|holdings|group|bank|university|institute|commission|council|government|ministry|department|agency|association|foundation|news|times|"
    r"journal|post|media|information|report|index|initiative|programme|program|project|act|summit|conference|week|court|parliament|congress|senate|white house|pentagon)\b"
)
DEVELOPER = (
    r"\b(?:gpus?|cuda|kubernetes|k8s|docker|containeri[sz]\w*|(?:gpu|compute|kubernetes|training|inference|hpc) clusters?|clusters? of gpus|sdks?|inference (?:gateway|endpoints?|server|serving|engine)|"
    r"model serving|api endpoints?|api[- ]only|(?:only |available )?(?:via|through) (?:the |an |its )?api|developer (?:api|platform|preview)|for developers|clis?|command[- ]line|in (?:the|your) terminal|"
    r"terminal (?:app|tool|commands?)|ides?|vs ?code|coding (?:assistant|agent|tool|model)s?|code (?:editor|assistant|completion|review|generation)|"
    r"(?:write|writing|generate|generating|review|reviewing|debug|debugging) code|codebases?|(?:code|git) repositor(?:y|ies)|git(?:hub)? (?:history|repos?)|pull requests?|fine[- ]?tun\w*|"
    r"local (?:llms?|models?)|run (?:llms?|models?) locally|ollama|llama\.cpp|lm studio|self[- ]host\w*|open[- ]weights?|vector (?:database|store)s?|embeddings|embedding models?|rag pipelines?|"
    r"first[- ]token latency|tokens per second|agent (?:harness|framework|orchestration|sdk)\w*|agents? from any provider|multi[- ]?agent|agent[- ]to[- ]agent|mcp servers?|aws|amazon web services|"
    r"sagemaker|(?:amazon |aws )bedrock|ec2|gcp|google cloud|vertex ai|azure|hyperpod)\b"
)
NO_CODE = r"\b(?:no[- ]code|without (?:writing )?(?:any )?code|drag[- ]and[- ]drop|point[- ]and[- ]click|visual (?:builder|editor)|non[- ]?(?:technical|developers?))\b"
#: "of course" and "gift certificate" are taken out first.
COURSE = (
    r"\b(?:courses?|e-?degrees?|certificat(?:e|es|ion|ions)|bootcamps?|masterclass(?:es)?|training bundle|(?:course|training|learning) (?:bundle|pack)|bundle of \w+ courses|"
    r"lifetime (?:access|deal|subscription|licen[cs]e)|resell\w*|wrapper (?:app|for)|access to (?:multiple|several|all the|many|\d+\+?) (?:ai )?(?:models|chatbots|ais))\b"
)
NO_COURSE = r"\bof courses?\b|\bgift certificat(?:e|es)\b"
SOURCE_HEDGES = (
    r"may|might|could|reportedly|allegedly|alleged|according to|claims?|claimed|suggests?|appears? to|seems? to|possibl[ey]|rumou?r(?:s|ed)?|sources? (?:say|said|tell)|is said to|are said to|"
    r"report says|reports say|in talks|considering|opinion"
)
ATTRIBUTIONS = (
    r"says?|said|tells?|told|report(?:s|ed)?|likely|would|expected to|plans? to|accus(?:es|ed)|warns?|argues?|debates?|whether|sees?|predicts?|expects?|estimates?|forecasts?|believes?|opinion:?"
)
OPEN_CLAIMS = (
    r"\b(?:study|studies|research|researchers|report|survey|paper|analysis|data)\s+(?:finds?|found|shows?|suggests?)\b|"
    r"\b(?:eyes|weighs|mulls|explores|seeks|tests?|tested|testing|examines?|investigat(?:es|ed|ing)|probes?|asks?|questions?)\b"
)
RELATIVE_HEDGE = r"\b(?:that|which|who|what)\s+(?:\S+\s+){0,3}(?:may|might|could)\b"
OPEN_QUESTION = r"^[^\p{L}\p{N}_]*(?:why|how|when|where|who|which|if|what)\b"


def discovery_term(term: Column) -> Column:
    t = F.trim(F.coalesce(term, F.lit("")))
    return F.length(t).between(3, 39) & ~has(t, GENERIC_TERM)


def card_screen(text: Column) -> Column:
    """Why a card doesn't belong: a course, or for developers without a screen that others can use; else null."""
    t = plain_dashes(text)
    return F.when(has(F.regexp_replace(t, f"(?i){NO_COURSE}", " "), COURSE), "course").when(has(t, DEVELOPER) & ~has(t, NO_CODE), "developer")


def title_asks(title: Column) -> Column:
    """Whether a title is a question: at most two words after its last question mark."""
    after = F.regexp_extract(F.coalesce(title, F.lit("")), r"(?s)\?([^?]*)$", 1)
    return F.contains(title, F.lit("?")) & (T.word_count(F.regexp_replace(after, r"[^\p{L}\p{N}_\s]", " ")) <= 2)


def claim_hedged(title: Column) -> Column:
    """Whether a title hedges its main claim, which ends at a dash, a colon or a sentence's end, or asks a real yes-or-no question."""
    marked = F.regexp_replace(F.regexp_replace(title, r"([a-z]{4})[.!]\s+([A-Z])", "$1\u0001$2"), r"([a-z]{3}['’”\"])[.!]\s+([A-Z])", "$1\u0001$2")
    claim = F.split_part(F.regexp_replace(marked, r"\s[—–-]\s|[—–]|:\s", "\u0001"), F.lit("\u0001"), F.lit(1))
    claim = F.regexp_replace(claim, f"(?i){RELATIVE_HEDGE}", " ")
    label = F.regexp_replace(F.regexp_replace(claim, r"(?i)\bopinion:", "\u0002:"), r"(?i)\bopinion\b", " ")
    hedge = has(F.replace(label, F.lit("\u0002"), F.lit("opinion")), rf"\b(?:{SOURCE_HEDGES})\b")
    before = F.regexp_extract(title, r"(?s)^(.*)\?", 1)
    opened = has(title, OPEN_QUESTION) & ~has(title, r"^[^\p{L}\p{N}_]*what\s+if\b")
    return F.coalesce(hedge | (title_asks(title) & ~before.rlike(r"[.!]\s+\S") & ~opened), F.lit(False))


def hedge_dropped(title: Column, headline: Column) -> Column:
    """Whether a headline states as a fact what its source's title only suggests."""
    kept = F.contains(headline, F.lit("?")) | has(headline, rf"\b(?:{SOURCE_HEDGES}|{ATTRIBUTIONS})\b") | has(headline, OPEN_CLAIMS)
    return F.coalesce((F.trim(title) != F.trim(headline)) & (F.trim(headline) != "") & claim_hedged(title) & ~kept, F.lit(False))

# -- fixed values: automated clients ----------------------------------------------------------------------------------------------------------

PROGRAMS = (
    "headlesschrome|phantomjs|puppeteer|playwright|selenium|lighthouse|pagespeed|python|curl/|wget|go-http|node-fetch|axios|okhttp|java/|libwww|scrapy|httpclient|facebookexternalhit"
)
CRAWLERS = "(bot|spider|crawler)([/;)-]|$)"
TRANSLATED = r"^https://[a-z0-9-]+[.]translate[.]goog$"


def client_verdict(origin: Column, agent: Column, allowed: list[str]) -> Column:
    """ok, or why a request isn't a reader's: a foreign origin, a program or crawler by its name, or no origin or name at all. Null headers are empty."""
    origin, agent = F.lower(F.coalesce(origin, F.lit(""))), F.lower(F.coalesce(agent, F.lit("")))
    return (
        F.when((origin != "") & ~origin.isin(allowed) & ~origin.rlike(TRANSLATED), "origin").when(agent.rlike(PROGRAMS) | agent.rlike(CRAWLERS), "client")
        .when(origin == "", "noorigin").when(agent == "", "noagent").otherwise("ok")
    )
