"""Reply banks, policies, criteria and gates that benchmark results depend on."""

TRIVIAL_REPLIES = ("yeah", "mm", "right", "ok", "okay", "mhm", "ha", "haha", "sure", "yep")
FREE_REPEATS = ("yeah", "mm", "right", "ok", "okay", "haha", "ha", "mhm", "sure", "yep", "no worries", "see you", "hey", "hi")

# Benchmark of emotional state: replies by what they commit to.
STATE_BANKS = {
    "attractor": (
        "no worries", "yeah exactly", "what do you mean?", "same, nothing going on here", "hey", "not bad, you?", "i'm good, how about you?",
        "oh nice, how's that going?", "no idea honestly", "see you", "haha",
    ),
    "positive": (
        "that's great", "that's great!", "nice", "oh nice", "good stuff", "glad to hear", "that's good", "nice one", "lovely", "happy for you",
        "that's brilliant", "sounds good", "can't complain then", "long may it last", "yeah nice", "that's lovely", "amazing", "congrats",
        "good to hear", "yeah exactly",
    ),
    "negative": (
        "that sounds rough", "that's rough", "sorry to hear that", "oh no, i'm sorry", "that sucks", "that's rubbish", "ugh, that's rough",
        "sorry about that", "hopefully tomorrow's better", "that's hard", "sounds exhausting", "hope it gets better", "i'm sorry", "oh no",
        "that's a shame", "rough one",
    ),
    "neutral": (
        "yeah", "mm", "right", "i see", "fair enough", "makes sense", "yeah?", "go on", "how come", "what happened", "oh really", "mm yeah",
    ),
}

# Benchmark of elaboration: stock replies, hedges, words that name nothing, subjects not to be made up.
GENERIC_REPLIES = (
    "that's great", "that's great!", "nice one", "good stuff", "that's brilliant", "ah lovely", "that's the way", "happy for you",
    "glad to hear it", "that sounds rough", "that sucks", "that's rubbish", "sorry to hear that", "oh no", "oh no, i'm sorry", "that's a pain",
    "rough one", "that's hard going", "sounds exhausting", "hope it picks up", "hopefully tomorrow's better", "yeah exactly", "i see", "mm",
    "right", "fair enough", "okay", "mhm", "go on", "no worries", "long may it last", "can't complain then", "not great is it",
    "ugh, that's grim", "that's lovely",
)
HEDGES = (
    r"how'?s (that|it) going", r"what happened", r"^tell me (more|about (it|that))", r"^how (come|so)$", r"^(oh )?really\??$",
    r"^what do you mean", r"^go on$",
)
STOP_WORDS = (
    "i", "you", "it", "that", "this", "the", "a", "an", "is", "was", "are", "were", "to", "of", "in", "on", "at", "for", "and", "or", "but",
    "so", "my", "your", "me", "we", "they", "he", "she", "them", "him", "her", "do", "did", "does", "have", "has", "had", "be", "been", "got",
    "get", "no", "not", "yeah", "yes", "oh", "ah", "well", "how", "what", "when", "where", "who", "why", "s", "t", "up", "out", "all", "just",
    "really", "very", "with", "about", "like", "if", "there", "here", "again", "still", "too", "then", "now", "one", "new", "much",
)
NOT_TO_INVENT = ("dog", "cat", "guitar", "nurse", "italy", "exam", "kitchen", "baking", "running", "sister", "job")

JUDGE_CRITERIA = (
    "naturalness", "context_relevance", "emotional_appropriateness", "conversational_continuity", "response_diversity", "human_likeness",
    "memory_of_recent_turns", "absence_of_ai_verbosity",
)

# Reply policies: (action, question, length class, example replies), and the token ceiling of each length class.
LENGTH_TOKENS = {"REACTION": 4, "VERY_SHORT": 8, "SHORT": 16, "MEDIUM": 32}
POLICIES = {
    "P01": ("RECIPROCATE", "QUESTION_ALLOWED", "VERY_SHORT", ("hey", "hi", "hey there")),
    "P04": ("ACKNOWLEDGE", "NO_QUESTION", "REACTION", ("no worries", "any time", "of course")),
    "P06": ("CLOSE", "NO_QUESTION", "VERY_SHORT", ("see you", "see ya", "night")),
    "P16": ("CONTINUE", "QUESTION_PREFERRED", "SHORT", ("oh nice, how's that going?", "oh really? how come")),
    "P17": ("CLARIFY", "QUESTION_PREFERRED", "VERY_SHORT", ("how do you mean?", "in what way?")),
    "P18": ("NEUTRAL_REACTION", "NO_QUESTION", "REACTION", ("mm", "right", "fair enough")),
}
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"

# What a message must hold for a remembered fact to be recalled.
RECALL_CUES = {
    "name": ("my name", "call me", "who am i"),
    "pet_name": ("pet", "dog", "cat", "called", "name"),
    "pet_type": ("pet", "animal", "dog", "cat"),
    "job": ("job", "work", "do for a living", "occupation"),
    "location": ("live", "from", "where am i"),
}
USER_NAME = r"(?i)\b(?:i'?m|i am|my name(?:'s| is)|call me)\s+([A-Za-z]{2,15})\b"
NOT_A_NAME = (
    "tired", "sorry", "good", "fine", "ok", "okay", "great", "sad", "happy", "bored", "busy", "back", "here", "home", "late", "done", "hungry",
    "so", "just", "not", "really", "still", "kinda", "pretty", "very", "excited", "stressed", "exhausted", "annoyed", "sick", "free", "off",
    "out", "in", "at", "on", "a", "an", "the", "gonna", "going", "trying", "thinking", "glad", "worried", "lonely", "confused", "curious",
    "new", "old", "fed",
)
USER_FACT = r"(?i)\bi (?:have|got|just|really|always|never|hate|love|like|started|finished|bought)\b[^.!?]{0,60}"

TIER_TARGETS = {1: 0.99, 2: 0.95, 3: 0.90}
PREAMBLES = (("so what have you been up to", "not much, you?"), ("did you see the weather today", "yeah, grim isn't it"))
