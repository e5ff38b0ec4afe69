"""Values that must be exactly these for results to agree with existing data and models."""

# The words pandas.read_csv reads as a missing value by default.
CSV_NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The characters Python's str.strip() removes (str.isspace() is true for them).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Id prefixes of the forum ("t3_" is a post, "t1_" a comment).
POST_PREFIX = "t3_"
COMMENT_PREFIX = "t1_"

# Fixed value: what a deleted author turns into.
MISSING_AUTHOR = "None"

# Record layouts.
POST_FIELDS = [
    "post_id", "title", "selftext", "url", "score", "num_comments", "created_utc", "author",
    "subreddit", "permalink", "is_self", "upvote_ratio",
]
COMMENT_FIELDS = ["comment_id", "body", "score", "created_utc", "author", "is_top_level", "parent_id"]
COMMENT_BY_ID_FIELDS = [
    "comment_id", "body", "score", "created_utc", "author", "subreddit", "permalink", "is_top_level",
    "parent_id", "post_id", "post_title", "distinguished", "is_submitter", "stickied",
]
REPLY_FIELDS = ["comment_id", "body", "score", "created_utc", "author", "parent_id", "depth"]
STORY_FIELDS = ["id", "story", "score", "author", "timestamp", "post_id", "prompt"]
PAIR_FIELDS = [
    "prompt", "chosen_story", "rejected_story", "chosen_comment_id", "rejected_comment_id",
    "chosen_comment_score", "rejected_comment_score", "chosen_username", "rejected_username",
    "chosen_timestamp", "rejected_timestamp",
]
TRAIN_FIELDS = ["prompt", "chosen_story", "rejected_story"]
TOKEN_FIELDS = [
    "input_ids_chosen", "attention_mask_chosen", "input_ids_rejected", "attention_mask_rejected",
]

# Defaults.
TOP_LIMIT = 1000
SEARCH_LIMIT = 100
REPLY_LIMIT = 50
VALIDATION_ROWS = 500
TEST_SIZE = 0.05
SPLIT_SEED = 42
MAX_LENGTH = 2048
TARGET_BATCH = 128

# Answer marker, its token ids in the model's vocabulary, and the label the loss ignores.
RESPONSE_MARKER = "### Assistant:"
RESPONSE_MARKER_IDS = [14711, 22103]
IGNORED_LABEL = -100

# The four prompt templates.
LONG_PROMPT_WITH_REASONING = """You are evaluating two creative writing responses (A and B) to the same writing prompt. These responses are similar to those posted on Reddit writing subreddits like r/WritingPrompts.

Your task is to predict which response would receive more upvotes from the Reddit community. Reddit users typically upvote creative writing that is engaging, original, well-written, and emotionally resonant.

When making your prediction, consider what makes content popular on Reddit:
- Originality and uniqueness of ideas
- Engaging narrative style and pacing
- Emotional impact and relatability
- Clever twists or satisfying conclusions
- Technical quality of writing

Story A:
{story_a}

Story B:
{story_b}

This is an experiment to test how well language models can predict human preferences in creative writing as expressed through Reddit's voting system.

Your verdict MUST follow this exact format:
Reasoning: [explain which response would likely get more Reddit upvotes and why]
Preferred: [A or B] (the one you predict would get more upvotes)
"""

SHORT_PROMPT_WITH_REASONING = """Evaluate creative writing responses A and B.

Story A:
{story_a}

Story B:
{story_b}

Consider these aspects:
- Originality: unique concepts, unexpected elements
- Imagery: sensory language and descriptions
- Emotional impact: how the writing affects the reader
- Coherence: logical flow and narrative structure
- Technical skill: language use and style

FORMAT REQUIRED:
Reasoning: [your evaluation]
Preferred: [A or B]
"""

LONG_PROMPT_VERDICT_ONLY = """You are evaluating two creative writing responses (A and B) to the same writing prompt. These responses are similar to those posted on Reddit writing subreddits like r/WritingPrompts.

Your task is to predict which response would receive more upvotes from the Reddit community. Reddit users typically upvote creative writing that is engaging, original, well-written, and emotionally resonant.

When making your prediction, consider what makes content popular on Reddit:
- Originality and uniqueness of ideas
- Engaging narrative style and pacing
- Emotional impact and relatability
- Clever twists or satisfying conclusions
- Technical quality of writing

Story A:
{story_a}

Story B:
{story_b}

This is an experiment to test how well language models can predict human preferences in creative writing as expressed through Reddit's voting system.

Your verdict MUST follow this exact format:
Preferred: [A or B] (the one you predict would get more upvotes)
"""

SHORT_PROMPT_VERDICT_ONLY = """Evaluate creative writing responses A and B.

Story A:
{story_a}

Story B:
{story_b}

Consider these aspects:
- Originality: unique concepts, unexpected elements
- Imagery: sensory language and descriptions
- Emotional impact: how the writing affects the reader
- Coherence: logical flow and narrative structure
- Technical skill: language use and style

FORMAT REQUIRED:
Preferred: [A or B]
"""
