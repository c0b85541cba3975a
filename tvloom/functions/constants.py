"""Fixed values that results must agree on, as plain text."""

# --- fixed values: names and qualities -------------------------------------------------
GENERIC_NAMES = "tv live stream channel canale".split()
IDENTITY_ORDER = {"tvg_id": 0, "name": 1, "url": 2}
DEFAULT_PRIORITY = 100
#: Words of picture quality that don't identify a channel, as a regular expression over folded text.
QUALITY = r"\b(?:4k|uhd|fhd|full\s*hd|1080p|1080i|hd|720p|sd|576p|480p)\b"
#: Score and expression, best first.
QUALITY_SCORES = [(400, r"\b(?:4k|uhd|2160p?)\b"), (300, r"\b(?:fhd|full\s*hd|1080p|1080i)\b"), (200, r"\b(?:hd|720p)\b"), (100, r"\b(?:sd|576p|480p)\b")]
QUALITY_SUFFIXES = ["4k", "uhd", "fhd", "full hd", "hd", "sd", "1080p", "720p", "576p", "480p"]

# --- fixed values: categories, in the order of the published playlist ------------------
CATEGORY_ORDER = {
    "RAI": 10, "MEDIASET": 20, "DISCOVERY": 30, "SKY": 40, "PLUTO TV": 50, "NEWS": 60, "SPORT": 70, "FILM": 80, "SERIE TV": 90,
    "DOCUMENTARI E LIFESTYLE": 100, "BAMBINI": 110, "MUSICA": 120, "REGIONALI E LOCALI": 130, "RADIO E VISUAL RADIO": 140,
    "RELIGIONE": 150, "INTRATTENIMENTO": 160, "ALTRO": 999,
}
#: Names that begin with one of these belong to the brand.
BRANDS = {
    "MEDIASET": "canale 5|italia 1|rete 4|20 mediaset|mediaset 20|iris|la5|cine34|focus|top crime|mediaset extra|tgcom24|tgcom 24|boing|cartoonito|italia 2|mediaset italia 2",
    "DISCOVERY": "dmax|nove|real time|giallo|food network|motor trend|hgtv|k2|frisbee|warner tv|discovery channel|discovery science|animal planet|eurosport",
    "SKY": "tv8|cielo|sky tg24|sky arte|sky uno|sky sport|sky cinema|sky nature|sky documentari",
}
#: Keywords looked for in " name group ", category by category.
KEYWORDS = [
    ("NEWS", "news|notizie|informazione|information|tg | tg|telegiornale"),
    ("SPORT", "sport|calcio|football|basket|tennis|motorsport|racing"),
    ("BAMBINI", "kids|children|cartoon|animation|bambini|ragazzi"),
    ("FILM", "movies|movie|cinema|film"),
    ("SERIE TV", "series|serie|fiction|soap|telenovela"),
    ("DOCUMENTARI E LIFESTYLE", "documentary|documentaries|documentari|science|scienza|nature|natura|travel|viaggi|cooking|food|lifestyle|factual|cultura|education"),
    ("MUSICA", "music|musica|concert|radio music"),
    ("REGIONALI E LOCALI", "regional|regionale|local|locale|tgr"),
    ("RELIGIONE", "religion|religione|religious|catholic|chiesa|cristian"),
    ("RADIO E VISUAL RADIO", "radio|visual radio"),
    ("INTRATTENIMENTO", "entertainment|intrattenimento|general|generali|varieta|comedy|reality"),
]

# --- fixed values: guide matching ------------------------------------------------------
TIERS = {"exact_tvg_id": 100.0, "normalized_tvg_id": 97.0, "exact_name": 92.0, "alias": 89.0}
LEAST_SIMILARITY = 86.0
RESOLUTIONS = "144p 240p 270p 288p 300p 360p 404p 432p 480p 540p 576p 720p 900p 1080p 1440p 2160p"
QUALITY_WORDS = frozenset(f"{RESOLUTIONS} 4k 8k uhd fhd fullhd full hd sd hq lq hevc h265 h264 av1 mpeg2 mpeg4".split())
TECHNICAL_WORDS = QUALITY_WORDS | frozenset("backup mirror fallback test demo source server feed geo blocked geoblocked geolocked only".split())
BRACKET_WORDS = TECHNICAL_WORDS | frozenset("it ita italian italiano italy eu europe international intl".split())
MEDIA_WORDS = frozenset("tv television televisione channel canale network rete".split())
LOCALE_WORDS = frozenset("italia italy italiano italiana italian".split())
IDENTIFIER_TAGS = (
    f"{RESOLUTIONS} 4k 8k uhd fhd fullhd hd sd hq lq hevc h265 h264 av1 backup mirror fallback test it ita italy italian de ger germany "
    "fr fra france es spa spain uk gb gbr us usa ch che at aut eu europe intl international"
).split()
#: Italian and English words of 0 to 20.
NUMBERS = [
    "zero", "uno one", "due two", "tre three", "quattro four", "cinque five", "sei six", "sette seven", "otto eight", "nove nine", "dieci ten",
    "undici eleven", "dodici twelve", "tredici thirteen", "quattordici fourteen", "quindici fifteen", "sedici sixteen", "diciassette seventeen",
    "diciotto eighteen", "diciannove nineteen", "venti twenty",
]
#: Canonical key: its other names.
ALIASES = {
    "rai1": "raiuno", "rai2": "raidue", "rai3": "raitre", "rainews24": "rainews rai24", "raimovie": "", "raipremium": "", "raigulp": "", "raiyoyo": "",
    "raistoria": "", "raiscuola": "", "raisport": "", "raisportplus": "raisportpiu raisport+", "canale5": "channel5", "italia1": "italiauno",
    "rete4": "retequattro", "mediaset20": "20 20mediaset ventimediaset", "italia2": "mediasetitalia2", "tgcom24": "mediasettgcom24", "la5": "", "iris": "",
    "cine34": "", "focus": "focustv", "topcrime": "", "mediasetextra": "", "boing": "", "cartoonito": "", "nove": "9 nove9 canale9 channel9", "dmax": "",
    "realtime": "", "giallo": "", "foodnetwork": "", "motortrend": "", "k2": "", "frisbee": "", "warnertv": "warner", "tv8": "", "cielo": "cielotv",
    "skytg24": "", "la7": "", "la7d": "",
}

# --- fixed values: stream health and publication ---------------------------------------
MEDIA_TYPES = ["mpegurl", "video/", "audio/", "octet-stream", "mp2t"]
MANIFEST_TYPES = ["application/vnd.apple.mpegurl", "application/x-mpegurl", "application/mpegurl", "audio/mpegurl", "audio/x-mpegurl"]
SEGMENT_TYPES = ["video/", "audio/", "application/octet-stream", "binary/octet-stream", "video/mp2t", "application/mp2t"]
SEGMENT_SUFFIXES = [".ts", ".m2ts", ".m4s", ".mp4", ".aac", ".mp3", ".ac3", ".ec3", ".webm"]
UNSUPPORTED_CODECS = ["av01", "dvh1", "dvhe", "theora"]
COUNTRY_ATTRIBUTES = ["tvg-country", "country", "country-code", "country_code", "region"]
COUNTRY_PARAMETERS = ["country", "countrycode", "country_code", "region", "market"]
COUNTRY_ALIASES = {"IT": ["IT", "ITA", "ITALIA", "ITALY", "EU", "EUROPE"]}
EXPIRY_PARAMETERS = ["exp", "expires", "expiry", "token_exp", "tokenexp", "expiration"]
TOKEN_PARAMETERS = ["hdnts", "hdnea", "token"]
HEADER_NAMES = {"user-agent": "User-Agent", "useragent": "User-Agent", "referer": "Referer", "referrer": "Referer", "origin": "Origin", "cookie": "Cookie"}
#: Milliseconds above which a response loses so many points.
LATENCY_PENALTIES = [(5000, 25), (2500, 18), (1500, 12), (750, 7), (250, 3)]
REDIRECT_PENALTY = 2
HARD_REASONS = ["country_mismatch", "hls_drm_detected", "hls_invalid_media_segment", "hls_no_media_segment", "hls_segment_token_expired", "hls_unsupported_codec", "non_media_payload", "token_expired"]
HARD_STATUSES = [404, 410]

# --- fixed values: sources -------------------------------------------------------------
RETRYABLE = [408, 425, 429, 500, 502, 503, 504]
SCHEMES = ["", "file", "http", "https"]
TRUSTED = 70
ALTERNATE_PRIORITY = 105
PREFERRED_LANGUAGES = ["it", "ita", "it-it"]
