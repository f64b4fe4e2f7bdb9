"""Word lists, patterns, thresholds and prices that results depend on.

Everything here is data, not logic. Each list is a default that every operator
accepts a replacement for. Patterns are used with the ``(?iU)`` flags (ignore
case, Unicode word edges), see :func:`any_of`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# --- fixed values: speech-recognition fillers (whole segment text) ----------
FILLER_PHRASES = [
    "продолжение следует",
    "субтитры сделал dimatorzok",
    "субтитры подогнал",
    "субтитры подогнал ник_сэмпай",
    "редактор субтитров а.семкин",
    "корректор а.егорова",
    "субтитры",
    "subscribe to my channel",
    "like and subscribe",
    "don't forget to subscribe",
    "music",
    "applause",
    "(music)",
    "[music]",
    "(applause)",
    "[applause]",
    "♪",
    "♫",
]
FILLER_PUNCTUATION = r""".,!?:;\-–—…"'()\[\]"""
FILLER_MIN_SECONDS = 5.0
FILLER_MAX_CHARS_PER_SECOND = 2.0
FILLER_MAX_STEMS = 2

# --- fixed values: markers of segments without speech ------------------------
NON_SPEECH_PATTERN = (
    r"(?iu)\[Music\]|\[Applause\]|\[Laughter\]|\[unintelligible\]|\(unintelligible\)"
    r"|\[Music playing\]|♪|🎵"
)

# --- fixed values: boilerplate phrases (text coverage) -----------------------
BOILERPLATE_PHRASES = [
    "thank you for watching",
    "thanks for watching",
    "thanks so much for watching",
    "thank you so much for watching",
    "thank you all for watching",
    "thank you for listening",
    "thanks for listening",
    "subtitles by",
    "subtitles created by",
    "captions by",
    "captions created by",
    "transcribed by",
    "please subscribe",
    "subscribe to my channel",
    "subscribe to the channel",
    "subscribe and like",
    "like and subscribe",
    "like share and subscribe",
    "don't forget to subscribe",
    "do not forget to subscribe",
    "don't forget to like",
    "hit the like button",
    "hit the subscribe button",
    "hit the bell icon",
    "ring the bell",
    "turn on notifications",
    "share this video",
    "please share",
    "thanks for tuning in",
    "see you next time",
    "see you in the next video",
    "see you in the next one",
    "catch you next time",
    "until next time",
    "goodbye for now",
    "take care everyone",
    "the end",
    "end of video",
    "end of the video",
    "that's all for today",
    "that's it for today",
    "that's all for now",
    "поделитесь видео",
    "подпишитесь на канал",
    "подпишись на канал",
    "ставьте лайк",
    "ставь лайк",
    "не забудьте подписаться",
    "спасибо за просмотр",
    "спасибо что смотрели",
    "до встречи в следующем видео",
    "до новых встреч",
    "всем пока",
    "напишите в комментариях",
    "по-русски русский subtitles by",
    "yandex subtitles",
    "amara.org",
    "generated automatically",
    "auto-generated by",
]

# --- fixed values: languages with a word list --------------------------------
DICTIONARY_LANGUAGES = ["en", "es", "fr", "pt", "de", "ru", "ar", "eu", "lv", "nl", "it"]
WORD_PATTERN = r"(?U)\b[a-zA-Zа-яА-ЯёЁ]+\b"

# --- fixed values: quality thresholds and weights ----------------------------
MUSIC_THRESHOLD = 0.25
OOV_THRESHOLD = 0.15
REPETITION_THRESHOLD = 0.3
BOILERPLATE_THRESHOLD = 0.1
PERPLEXITY_THRESHOLD = 0.5
PERPLEXITY_PENALTY = 0.25
PERPLEXITY_BASE = 50.0
PERPLEXITY_RANGE = 150.0

# --- fixed values: action verbs of a screen tutorial -------------------------
ACTION_PATTERNS = [
    r"\bкл(ик|икае(м|шь)|икни|икни(те)?)\b",
    r"\bнажм[уём]\b",
    r"\bнажима(ем|ешь|й)\b",
    r"\bжмём?\b",
    r"\bжмякн[уём]\b",
    r"\bтап(ае(м|шь)|ни|ни(те)?)\b",
    r"\bвыбира(ем|ешь|й)\b",
    r"\bвыбер(ем|и|ите)\b",
    r"\bввод(им|ишь|и)\b",
    r"\bвведи(те)?\b",
    r"\bпиш(ем|ешь|и|ите)\b",
    r"\bнапиш(ем|и|ите)\b",
    r"\bоткр(оем|ываешь|ой|ойте|ываем)\b",
    r"\bзакр(оем|ываешь|ой|ойте|ываем)\b",
    r"\bперех(одим|одишь|оди|одите)\b",
    r"\bсохран(яем|и|ишь|ите|им)\b",
    r"\bкопир(уем|ую|уй|уйте)\b",
    r"\bвст(авляем|авь|авьте)\b",
    r"\bпрокр(учиваем|ути|утите)\b",
    r"\bвыдел(яем|и|ите)\b",
    r"\bпереместим|перетащим|потащим\b",
    r"\bпролист(аем|ай|айте)\b",
    r"\bclick(ing|s|ed)?\b",
    r"\btap(ping|s|ped)?\b",
    r"\bpress(ing|es|ed)?\b",
    r"\bselect(ing|s|ed)?\b",
    r"\bchoos(e|ing|es)\b",
    r"\btyp(e|ing|es|ed)\b",
    r"\benter\b",
    r"\bopen(ing|s|ed)?\b",
    r"\bclos(e|ing|es|ed)\b",
    r"\bnavigat(e|ing|es|ed)\b",
    r"\bgo to\b",
    r"\bsav(e|ing|es|ed)\b",
    r"\bcop(y|ying|ies|ied)\b",
    r"\bpast(e|ing|es|ed)\b",
    r"\bdrag(ging|s)?\b",
    r"\bdrop(ping|s|ped)?\b",
    r"\bscroll(ing|s|ed)?\b",
    r"\bhighlight(ing|s|ed)?\b",
    r"\bswitch(ing|es|ed)?\b",
]
TUTORIAL_MIN_PER_MINUTE = 1.5
TUTORIAL_MIN_MINUTES = 0.5

# --- fixed values: connectives between the steps of a procedure --------------
CONNECTIVE_PATTERNS = [
    r"\bthen\b",
    r"\bafter (that|this)\b",
    r"\bnext\b",
    r"\bfirst(ly)?\b",
    r"\bsecond(ly)?\b",
    r"\bthird(ly)?\b",
    r"\bfinally\b",
    r"\bonce you\b",
    r"\bfrom (here|there)\b",
    r"\bat this point\b",
    r"\bstep\b",
    r"\bafterwards?\b",
    r"\bпотом\b",
    r"\bзатем\b",
    r"\bдалее\b",
    r"\bсначала\b",
    r"\bпосле (этого|чего)\b",
    r"\bтеперь\b",
    r"\bв конце\b",
    r"\bна этом (этапе|шаге)\b",
    r"\bшаг\b",
]


@dataclass(frozen=True)
class TypeRule:
    """A video type, its patterns, and the hits per minute that make it a match."""

    name: str
    per_minute: float
    patterns: tuple[str, ...]


# --- fixed values: video types, in the order that breaks ties ----------------
TYPE_RULES = [
    TypeRule("tutorial", 1.5, (
        r"\bкл(ик|икае(м|шь)|икни|икни(те)?)\b",
        r"\bнажм[уём]\b",
        r"\bнажима(ем|ешь|й)\b",
        r"\bжмём?\b",
        r"\bвыбира(ем|ешь|й)\b",
        r"\bвыбер(ем|и|ите)\b",
        r"\bввод(им|ишь|и)\b",
        r"\bпиш(ем|ешь|и|ите)\b",
        r"\bнапиш(ем|и|ите)\b",
        r"\bоткр(оем|ываешь|ой|ойте|ываем)\b",
        r"\bзакр(оем|ываешь|ой|ойте|ываем)\b",
        r"\bперех(одим|одишь|оди|одите)\b",
        r"\bсохран(яем|и|ишь|ите|им)\b",
        r"\bкопир(уем|ую|уй|уйте)\b",
        r"\bвст(авляем|авь|авьте)\b",
        r"\bclick(ing|s|ed)?\b",
        r"\btap(ping|s|ped)?\b",
        r"\bpress(ing|es|ed)?\b",
        r"\bselect(ing|s|ed)?\b",
        r"\bchoos(e|ing|es)\b",
        r"\btyp(e|ing|es|ed)\b",
        r"\bopen(ing|s|ed)?\b",
        r"\bclos(e|ing|es|ed)\b",
        r"\bnavigat(e|ing|es|ed)\b",
        r"\bgo to\b",
        r"\bsav(e|ing|es|ed)\b",
        r"\bcop(y|ying|ies|ied)\b",
        r"\bpast(e|ing|es|ed)\b",
        r"\bscroll(ing|s|ed)?\b",
    )),
    TypeRule("code", 2.0, (
        r"\bfunction\b",
        r"\bclass\b",
        r"\bimport\b",
        r"\breturn\b",
        r"\bvariable\b",
        r"\bparameter\b",
        r"\bdef \b",
        r"\bconst \b",
        r"\blet \b",
        r"\bvar \b",
        r"\barray\b",
        r"\bobject\b",
        r"\berror\b",
        r"\bexception\b",
        r"\bstack trace\b",
        r"\bcomp(il)?e\b",
        r"\bdebug(ging|ger)?\b",
        r"\bcommand line\b",
        r"\bterminal\b",
        r"\b(npm|pip|cargo|yarn)\s+(install|run)\b",
        r"\b(github|repository|repo|commit|pull request)\b",
        r"\bфункци[яи]\b",
        r"\bкласс\b",
        r"\bперемен(ная|ной)\b",
        r"\bошибк(а|и)\b",
        r"\bдебаг\b",
        r"\bкод\b",
    )),
    TypeRule("lecture", 0.5, (
        r"\btoday (we'll|we will|i'll)\b",
        r"\bin this (lecture|talk)\b",
        r"\bresearch shows\b",
        r"\bstud(y|ies) (show|suggest)\b",
        r"\bhypothes(is|es)\b",
        r"\bin this slide\b",
        r"\bnext slide\b",
        r"\bas you can see (in|on) the (slide|chart|graph|figure)\b",
        r"\bthe (concept|principle|theorem|equation|formula)\b",
        r"\bлекци[яи]\b",
        r"\bсегодня (мы|я) (поговорим|расскаж)\b",
        r"\bисследовани[ея] показ\b",
        r"\bпринц[иы]п\b",
        r"\bна слайде\b",
        r"\bна графике\b",
        r"\bна диаграмме\b",
        r"\bтеори[яи]\b",
    )),
    TypeRule("demo", 0.5, (
        r"\b(new|new feature|just launched|introducing|announce|release)\b",
        r"\b(beta|alpha|preview|public release)\b",
        r"\b(try it|sign up|get started|free trial)\b",
        r"\b(feature|capability|workflow)\b",
        r"\bsubscri(be|ption)\b",
        r"\bpricing\b",
        r"\bновая (фича|функция|версия)\b",
        r"\bпредставляем\b",
        r"\bзапустили\b",
        r"\bпопробу(й|йте|ем)\b",
        r"\bподписк[ау]\b",
    )),
    TypeRule("review", 0.5, (
        r"\b(unbox(ing)?|reviewing|review of)\b",
        r"\bspecs?\b",
        r"\bbenchmark\b",
        r"\bworth (it|the money)\b",
        r"\bpros (and|\|) cons\b",
        r"\b(comparison|compared to|versus|vs\.?)\b",
        r"\bin the box\b",
        r"\bpack(ag(e|ing)|aging)\b",
        r"\bобзор\b",
        r"\bраспаковк[аи]\b",
        r"\bсравнени[ея]\b",
        r"\bстоит ли\b",
        r"\bв коробке\b",
    )),
    TypeRule("interview", 0.4, (
        r"\b(welcome|joining (me|us) today|my guest)\b",
        r"\b(host|guest|interviewer)\b",
        r"\bso (you|your) (work|company|research)\b",
        r"\btell (me|us) about\b",
        r"\bthank you for (joining|coming|being)\b",
        r"\bin your (opinion|view|experience)\b",
        r"\b(добро пожаловать|у нас в гостях|мой гость)\b",
        r"\bрасскажи(те)? о (своей|своём)\b",
        r"\bспасибо что (пришёл|пришли|присоединил)\b",
    )),
    TypeRule("vlog", 0.4, (
        r"\b(today i'm|i decided|i wanted|my day|let me show you my)\b",
        r"\b(yesterday i|this morning i|last week i)\b",
        r"\b(coffee|breakfast|grocery|walking around|street)\b",
        r"\b(home|apartment|kitchen|bedroom)\b",
        r"\b(welcome back to my channel|subscribe to my)\b",
        r"\bсегодня я\b",
        r"\bвчера я\b",
        r"\bу меня дома\b",
        r"\bпрогул(ка|яюсь)\b",
        r"\bна кухне\b",
        r"\bподпишитесь на мой канал\b",
    )),
]
TYPE_MAX_SCORE = 5.0
TALKING_HEAD_MIN_MINUTES = 1.0
TALKING_HEAD_MAX_PER_MINUTE = 0.3

# --- fixed values: report template of each video type ------------------------
REPORT_TYPES = {
    "tutorial": "tutorial",
    "code": "tutorial",
    "demo": "tutorial",
    "vlog": "vlog",
    "lecture": "generic",
    "interview": "generic",
    "review": "generic",
    "talking_head": "generic",
    "generic": "generic",
}
DEFAULT_REPORT_TYPE = "generic"


UNIVERSAL_THRESHOLD = 0.65
SOFT_SCORE = 0.9
ENGLISH_DETERMINERS = ["the", "a", "an", "this", "that", "these", "those"]

# --- fixed values: hosts of each platform ------------------------------------
PLATFORM_HOSTS = {
    "youtube": ["youtube.com", "youtu.be"],
    "instagram": ["instagram.com"],
    "tiktok": ["tiktok.com"],
}
YOUTUBE_ID_PATTERN = (
    r"(?iU)^(?:https?://)?(?:www\.)?"
    r"(?:youtube\.com/(?:watch\?v=|shorts/|embed/)|youtu\.be/)([\w\-]+)"
)
INSTAGRAM_CODE_PATTERN = (
    r"(?iU)^(?:https?://)?(?:www\.)?instagram\.com/(?:p|reel|tv|reels)/([\w\-]+)"
)
PROFILE_PATTERNS = {
    "youtube": r"(?iU)^(?:https?://)?(?:www\.)?youtube\.com/"
               r"(?:@[\w\-.]+|c/[\w\-.]+|channel/[\w\-]+|user/[\w\-]+)/?",
    "tiktok": r"(?iU)^(?:https?://)?(?:www\.)?tiktok\.com/(@[\w\-.]+)/?$",
    "instagram": r"(?iU)^(?:https?://)?(?:www\.)?instagram\.com/"
                 r"(?!p/|reel/|reels/|tv/|stories/|explore/)([\w\-.]+)/?",
}
POST_PATTERNS = {
    "youtube": r"(?iU)^(?:https?://)?(?:www\.|m\.)?"
               r"(?:youtube\.com/(?:watch\?v=|shorts/|embed/|live/)|youtu\.be/)",
    "instagram": r"(?iU)^(?:https?://)?(?:www\.)?instagram\.com/(?:p|reel|reels|tv)/",
    "tiktok": r"(?iU)^(?:https?://)?(?:www\.|vm\.|vt\.)?tiktok\.com/(?:@[\w\-.]+/video/|\w+/?)",
}
VIDEO_ID_PATTERN = r"(?U)^[\w-]{6,20}$"


@dataclass(frozen=True)
class ErrorRule:
    """An error pattern of one platform (or ``generic``), its class, and whether cookies help."""

    platform: str
    pattern: str
    error_class: str
    retryable: bool


# --- fixed values: downloader errors, most specific first --------------------
ERROR_RULES = [
    ErrorRule("youtube", r"sign in to confirm you'?re not a bot", "anti_bot", True),
    ErrorRule("youtube", r"confirm your age", "login_required", True),
    ErrorRule("youtube", r"video is private", "video_unavailable", False),
    ErrorRule("youtube", r"members[- ]only", "login_required", True),
    ErrorRule("youtube", r"video unavailable", "video_unavailable", False),
    ErrorRule("youtube", r"this video has been removed", "video_unavailable", False),
    ErrorRule("youtube", r"this video is no longer available", "video_unavailable", False),
    ErrorRule("youtube", r"not (?:made )?(?:this video )?available in your country",
              "video_unavailable", False),
    ErrorRule("youtube", r"blocked it in your country|geo[- ]restrict", "video_unavailable", False),
    ErrorRule("youtube", r"http error 403", "anti_bot", True),
    ErrorRule("youtube", r"http error 429", "rate_limit", True),
    ErrorRule("instagram", r"please wait a few minutes", "rate_limit", True),
    ErrorRule("instagram", r"rate[- ]limit", "rate_limit", True),
    ErrorRule("instagram", r"login (?:required|needed)|login.*session|requires.*logged.in",
              "login_required", True),
    ErrorRule("instagram", r"this account is private", "login_required", True),
    ErrorRule("instagram", r"this content (?:is not available|cannot be found)",
              "video_unavailable", False),
    ErrorRule("instagram", r"http error 401", "login_required", True),
    ErrorRule("instagram", r"http error 403", "anti_bot", True),
    ErrorRule("instagram", r"http error 429", "rate_limit", True),
    ErrorRule("tiktok", r"login required to view", "login_required", True),
    ErrorRule("tiktok", r"this video is age[- ]restricted", "login_required", True),
    ErrorRule("tiktok", r"video (?:is no longer available|has been removed|is private)",
              "video_unavailable", False),
    ErrorRule("tiktok", r"http error 403", "anti_bot", True),
    ErrorRule("tiktok", r"http error 429", "rate_limit", True),
    ErrorRule("generic", r"unable to extract data|marked as broken", "extractor_broken", False),
    ErrorRule("generic",
              r"(?:timed out|connection (?:reset|refused|aborted)|name (?:or service )?not known)",
              "network", False),
]

# --- fixed values: USD per million tokens, (model, input, output) ------------
MODEL_PRICES = [
    ("gemini-2.5-flash", 0.30, 2.50),
    ("gemini-2.5-pro", 1.25, 10.00),
    ("gemini-3.5-flash", 1.50, 9.00),
    ("llama-3.3-70b-versatile", 0.59, 0.79),
    ("meta-llama/llama-4-scout-17b-16e-instruct", 0.11, 0.34),
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini", 0.15, 0.60),
]
CACHED_TOKEN_SHARE = 0.25

# --- fixed values: writing system of each language (all others: latin) -------
SCRIPT_LANGUAGES = {
    "cyrillic": ["ru", "uk", "bg", "sr", "mk", "be", "kk"],
    "cjk": ["zh", "ja", "ko"],
    "arabic": ["ar", "fa", "ur", "he"],
}
# In the order that breaks ties between equal counts.
SCRIPT_RANGES = {
    "cyrillic": r"[^Ѐ-ӿ]",
    "cjk": r"[^一-鿿぀-ゟ゠-ヿ가-힯]",
    "arabic": r"[^؀-ۿ֐-׿]",
    "latin": r"[^A-Za-z]",
}

# --- fixed values: claims in captions ----------------------------------------
IMAGE_PATTERN = r"!\[([^\]]*)\]\(([^)]+)\)"
URL_PATTERN = r"""(?U)https?://\S+|(?:[\w-]+\.)+[\w-]{2,}/[^\s)\]»"'”’]*"""
NUMBER_PATTERN = r"(?U)(?<![\w.])[+\-]?\d+(?:[.,\s]\d+)*%?(?![\w])"
QUOTED_PATTERN = r'«([^»]{2,})»|“([^”]{2,})”|"([^"]{2,})"'


def any_of(patterns) -> str:
    """One case-insensitive regular expression that matches where any pattern does."""
    return "(?iU)(?:" + ")|(?:".join(patterns) + ")"


def leading_literals(pattern: str) -> list[str]:
    """Lower-case texts of which any match of the pattern holds one, by what its alternatives begin with; none where one has no such text."""
    depth, parts = 0, [""]
    for c in pattern:
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    heads = []
    for part in parts:
        head = re.match(r"(?:\\b)?([a-zа-яё ]*)(.?)", part)
        heads.append(head[1][:-1] if head[2] in ("?", "*", "{") and head[2] else head[1])
    return heads if all(heads) else []
