"""Fixed values that results depend on, and defaults of parameters.

Everything here is a plain value that a caller may replace by an argument of the operator that uses it.
"""

from __future__ import annotations

# Word lists.
LENGTH_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "to", "for", "of", "in", "on", "at", "by", "this", "that", "it", "with", "as",
    "i", "you", "he", "she", "they", "we", "my", "your",
]
TERM_STOP_WORDS = [
    "the", "and", "a", "of", "to", "is", "in", "it", "i", "you", "that", "this", "on", "for", "with", "as", "at", "by", "an", "be", "my", "have",
    "but", "not", "they", "was", "are",
]
ROUTING_STOP_WORDS = [
    "what", "how", "why", "who", "where", "when", "does", "user", "users", "feature", "features", "experience",
]
TERM_PRIORITY_WORDS = [
    "shuffle", "recommendation", "recommendations", "recommend", "playlist", "playlists", "discover", "weekly", "radar", "mix", "dj", "ads",
    "premium", "song", "songs", "music",
]
PRIORITY_KEYWORDS = ["discover weekly", "discover", "release radar", "smart shuffle", "daily mix", "recommendations", "recommend", "home feed", "ai dj", "algorithmic", "shuffle"]
DISCOVERY_KEYWORDS = [
    "discover", "recommend", "shuffle", "playlist", "algorithm", "repeat", "find", "search", "weekly", "radar", "mix", "autoplay", "repetition",
    "loop", "dj",
]
BUG_KEYWORDS = [
    "crash", "freeze", "bug", "error", "slow", "lag", "stop", "offline",
]
ALLOWED_LANGUAGES = [
    "en", "hi", "bn", "gu", "kn", "ml", "mr", "pa", "ta", "te", "ur",
]
CONFUSABLE_LANGUAGES = [
    "so", "tl", "af", "et", "ro", "cy", "sl", "no",
]
HINGLISH_AUDIT_WORDS = [
    "hai", "h", "bhai", "achha", "acha", "bohot", "bahut", "ke", "ki", "ko", "se", "ka", "yaar", "aap", "tum", "ho", "na", "hi", "bhi", "toh", "tha",
    "rha", "raha", "rhi", "gaya", "ab", "kar", "kr", "kya", "karna", "karke", "likha", "sath", "saath", "aur", "ya", "lekin", "par", "pe", "hota",
    "hote", "baje", "gaye", "diya", "liya", "kuch",
]
HINGLISH_WORDS = [
    *HINGLISH_AUDIT_WORDS,
    "nahin", "nahi", "nahe", "aa", "rahe", "krta", "karta", "karti", "karte", "lagta", "lagti", "lagte", "badhiya", "badiya", "mast", "bekar",
    "bakwas", "worse", "ads", "song", "songs", "chal", "chala", "chalata", "chalati", "chalate", "hata", "do", "de", "di", "sahi", "saza", "kam",
    "jyada", "zyada", "bhaut", "he", "hu", "hoon", "thi", "the", "kro", "karo", "kyu", "kyon", "apna", "apni", "apne", "mera", "meri", "mere",
    "mujhe", "mujhse", "humein", "hum", "sab", "log", "bro", "sir", "please", "pls", "plz", "bhia", "hiii", "heee",
]
DEVICE_RULES = (
    ("car", ["car", "android auto", "driving", "dash", "carplay", "vehicle", "infotainment"]),
    ("tv", ["tv", "smart tv", "android tv", "firestick", "television", "chromecast"]),
    ("tablet", ["tablet", "ipad", "galaxy tab", "tab s"]),
    ("pc", ["pc", "laptop", "chromebook", "desktop", "computer", "windows", "mac"]),
    ("wearable", ["watch", "wearos", "wear os", "galaxy watch", "pixel watch"]),
)
QUESTION_RULES = {
    "RQ1": ["discover", "find", "search", "stale", "slow", "freeze", "crash"],
    "RQ2": ["repeat", "repetition", "loop", "same", "shuffle", "shuffled"],
    "RQ3": ["algorithm", "recommend", "recommendation", "bias", "push"],
    "RQ4": ["playlist", "search", "weekly", "dj", "autoplay"],
    "RQ5": ["weekly", "radar", "shuffle", "dj", "daily"],
    "RQ6": ["car", "driving", "home", "sonos", "casting", "gym", "workout", "offline"],
    "RQ7": ["premium", "free", "ad", "ads", "subscription", "pay"],
}
# Keys of a gazetteer with the name they stand for; regions and cities.
REGIONS = {
    "andhra pradesh": "Andhra Pradesh", "arunachal pradesh": "Arunachal Pradesh", "assam": "Assam", "bihar": "Bihar", "chhattisgarh": "Chhattisgarh",
    "goa": "Goa", "gujarat": "Gujarat", "haryana": "Haryana", "himachal pradesh": "Himachal Pradesh", "jharkhand": "Jharkhand",
    "karnataka": "Karnataka", "kerala": "Kerala", "madhya pradesh": "Madhya Pradesh", "maharashtra": "Maharashtra", "manipur": "Manipur",
    "meghalaya": "Meghalaya", "mizoram": "Mizoram", "nagaland": "Nagaland", "odisha": "Odisha", "punjab": "Punjab", "rajasthan": "Rajasthan",
    "sikkim": "Sikkim", "tamil nadu": "Tamil Nadu", "telangana": "Telangana", "tripura": "Tripura", "uttar pradesh": "Uttar Pradesh",
    "uttarakhand": "Uttarakhand", "west bengal": "West Bengal", "ladakh": "Ladakh", "puducherry": "Puducherry", "chandigarh": "Chandigarh",
    "jammu": "Jammu & Kashmir", "kashmir": "Jammu & Kashmir", "pondicherry": "Puducherry",
}
CITIES = {
    "delhi": "Delhi NCR", "new delhi": "Delhi NCR", "ncr": "Delhi NCR", "noida": "Delhi NCR", "greater noida": "Delhi NCR", "ghaziabad": "Delhi NCR",
    "gurugram": "Delhi NCR", "gurgaon": "Delhi NCR", "faridabad": "Delhi NCR", "mumbai": "Mumbai", "bombay": "Mumbai", "thane": "Mumbai",
    "navi mumbai": "Mumbai", "pune": "Pune", "nagpur": "Maharashtra", "bengaluru": "Bengaluru", "bangalore": "Bengaluru", "mysore": "Karnataka",
    "hubli": "Karnataka", "mangalore": "Karnataka", "chennai": "Chennai", "madras": "Chennai", "coimbatore": "Tamil Nadu", "madurai": "Tamil Nadu",
    "hyderabad": "Hyderabad", "secunderabad": "Hyderabad", "warangal": "Telangana", "kolkata": "Kolkata", "calcutta": "Kolkata",
    "darjeeling": "West Bengal", "ahmedabad": "Gujarat", "surat": "Gujarat", "vadodara": "Gujarat", "baroda": "Gujarat", "rajkot": "Gujarat",
    "jaipur": "Rajasthan", "jodhpur": "Rajasthan", "udaipur": "Rajasthan", "lucknow": "Uttar Pradesh", "kanpur": "Uttar Pradesh", "patna": "Bihar",
    "ranchi": "Jharkhand", "jamshedpur": "Jharkhand", "bhopal": "Madhya Pradesh", "indore": "Madhya Pradesh", "gwalior": "Madhya Pradesh",
    "jabalpur": "Madhya Pradesh", "raipur": "Chhattisgarh", "bhubaneswar": "Odisha", "cuttack": "Odisha", "guwahati": "Assam", "amritsar": "Punjab",
    "ludhiana": "Punjab", "jalandhar": "Punjab", "kochi": "Kerala", "cochin": "Kerala", "trivandrum": "Kerala", "thiruvananthapuram": "Kerala",
    "visakhapatnam": "Andhra Pradesh", "vizag": "Andhra Pradesh", "vijayawada": "Andhra Pradesh", "guntur": "Andhra Pradesh",
    "dehradun": "Uttarakhand", "shimla": "Himachal Pradesh", "srinagar": "Jammu & Kashmir",
}
# Anchor phrases that tags are projected on.
ANCHORS = {
    "goal_play_music": "play music listen to songs streaming audio",
    "goal_discover": "discover new music find new artists recommendations",
    "method_playlist": "my playlist custom playlist curation song list",
    "method_algorithmic": "discover weekly release radar smart shuffle daily mix ai dj autoplay recommendation",
    "method_search": "search bar find song search artist manual search type song",
    "context_car": "driving carplay android auto bluetooth car in the car road trip vehicle steering wheel",
    "context_home": "smart speaker alexa google home sonos casting tv smart home chromecast speaker",
    "context_gym": "workout gym running exercise training lifting fitness treadmill cardio",
    "context_work": "focus studying working office concentration coding writing thinking study",
    "context_commute": "bus train metro subway walking commuting transit travel passenger",
    "emotion_anger": "terrible worst garbage trash hate useless irritating annoying broken laggy crash freeze",
    "emotion_joy": "amazing love perfect great best awesome excellent happy wonderful beautiful smooth",
    "frustration_ads": "ads every two songs unskippable ads commercial interruption too many ads advertising",
    "frustration_repetition": "repetition same songs repeating loop shuffle playing same tracks over and over",
    "frustration_bugs": "crashes keeps stopping buggy update glitch frozen error loading offline",
    "workaround_reinstall": "clear cache reinstall restart uninstall login logout downgrade version",
    "feature_request_playlist": "playlist limit increase folders sorting custom cover playlist description",
    "churn_indicator": "uninstalling canceling subscription switching to youtube going to apple music quitting leaving",
    "competitor_youtube": "youtube music yt music premium adblock",
    "competitor_apple": "apple music amzn music prime wynk jiosaavn",
}
# Thresholds.
ADAPTIVE_THRESHOLDS = ((500, 0.80), (1500, 0.75), (4000, 0.70), (8000, 0.65))
ADAPTIVE_FLOOR = 0.60
MERGE_THRESHOLD, ANCHOR_THRESHOLD, THEME_THRESHOLD = 0.70, 0.35, 0.60
LSH_PERMUTATIONS, LSH_BANDS, LSH_THRESHOLD, SHINGLE = 128, 16, 0.80, 3
MIN_WORDS, HORIZON_DAYS, SUMMARY_WORDS, SUMMARY_SENTENCES = 3, 180, 150, 3
DEFAULT_RATING, DEFAULT_SIMILARITY, DEFAULT_SCORE = 3.0, 0.80, 20.0
SOURCES = ("google_play", "app_store", "reddit", "youtube", "community_forum")
UNRELATED = {"unrelated_general": "General Feedback", "unrelated_ads": "Ads & Premium Access", "unrelated_bugs": "Technical Bugs & Instability", "unrelated_widgets": "Home Screen Widgets"}
