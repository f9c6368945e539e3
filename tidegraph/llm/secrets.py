"""Secret scans: candidates by pattern, false positives removed by a random forest.

A pattern finds candidates (known key formats, values given to a name like
password, long mixed tokens). A random forest, trained on labelled findings,
judges each by its length, transitions between kinds of characters, how likely
its pairs of letters are in words, coverage by a dictionary, the path around it
and the words beside it. The trained trees become one column expression, so
candidates are found, judged and cut out where their document is read: nothing
is shuffled, but where a table has fewer partitions than there are cores.

`labelled_findings` makes findings with known labels by rule (key formats,
tokens beside their names; against them digests, identifiers, numbers, paths,
placeholders beside theirs); a table of reviewed findings of the same columns
can be given instead.

Defined results: null and empty texts have no findings; texts and candidates of
any length are taken whole, in time linear in them (all looks ahead and behind
are bounded, but a private key's body ends at its 200th single dash); null sources are
no path; a score is the mean of the trees' shares of secrets, and one of exactly
`least` (a tie) is no secret; repeated rows are scanned each; an empty table
gives an empty result; extra columns of any name pass through `redact`
unchanged, and `findings` doesn't read them.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import pairwise

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import as_row, from_row, spread

#: Formats that say what they are, by kind.
FORMATS = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "json_web_token": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "google_api_key": r"\bAIza[A-Za-z0-9_-]{35}",
    "service_token": r"\b(?:SG\.[A-Za-z0-9_-]{16,64}\.[A-Za-z0-9_-]{16,64}|sk-[A-Za-z0-9_-]{20,200}|hf_[A-Za-z0-9]{30,64}|glpat-[A-Za-z0-9_-]{20,64}|npm_[A-Za-z0-9]{36}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,120}|pypi-[A-Za-z0-9_-]{32,240}|xapp-[A-Za-z0-9-]{20,120})",
    # up to its END mark, header lines and all; without one, headers and the lines of its body
    "private_key": r"-----BEGIN [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----(?:[A-Za-z0-9+/=\s:,.()\\_]*+(?:-(?!----)[A-Za-z0-9+/=\s:,.()\\_]*+){0,200}-----END [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----|(?:\s{0,4}[A-Za-z][A-Za-z-]{0,30}: [^\r\n]{0,200}){0,8}(?:(?:\s|\\[nr]){1,4}[A-Za-z0-9+/]{24,128}={0,2}){1,400})",
}
#: Names whose values are secrets, with anything before and after them, and words that go with what only looks like one.
NAMES = r"(?:pass(?:word|wd|phrase|code)|(?<![a-z])pass(?![a-z])|pwd|secret|token|(?:api|access|private|signing|encryption|account)[_.-]?key|auth|bearer|credential)"
HARMLESS = r"(?:sha\d*|commit|checksum|md5|uuid|guid|digest|hash|revision|build|version|isbn|order|tracking|serial|example|sample|etag|integrity|base64|product|part|model|id)"
#: The name of an assignment (also a quoted one, or with a scheme after it), a bearer's token, a user in an address.
_NAMED = r"(?i:" + NAMES.replace("a-z", "A-Za-z") + r")[\w.-]{0,64}(?:\\?[\"'])?[ \t]{0,3}[=:]{1,2}>?[ \t]{0,3}(?:\\?[\"'])?(?:(?i:bearer|basic|token)[ \t]{1,3})?"
#: What is said to be a password; it has to have a digit.
_SPOKEN = r"\b(?i:password|passphrase|passcode)[ \t]{1,3}(?i:is|was)[ \t]?:?[ \t]{1,3}[\"']?"
_BEARER = r"\b(?i:bearer)[ \t]{1,3}"
_USER = r"://[^\s/:@\"'?#<>]{0,128}:"
PREFIX = "(?:" + "|".join([_NAMED, _SPOKEN, _BEARER, _USER]) + ")"
ASSIGNED = "|".join([_NAMED + r"(?!-----BEGIN )[^\s\"']{3,}[^\s\"'\\]", _SPOKEN + r"(?=[^\s\"'0-9]{0,64}[0-9])[^\s\"']{3,}[^\s\"'\\.,;]", _BEARER + r"[A-Za-z0-9+/_.~-]{16,}={0,2}", _USER + r"[^\s/\"'<>]{1,256}(?=@)"])
#: What makes the end of a token the name of an assignment (or its beginning, with dots after it). Both looks are bounded.
_TAIL = r"(?<=(?i:" + NAMES.replace("a-z", "A-Za-z") + r")[\w-]{0,64})[\w.-]{0,64}(?:\\?[\"'])?[ \t]{0,3}[=:]{1,2}>?[ \t]{0,3}(?:\\?[\"'])?[^\s\"']"
#: A long token with a digit that is not itself the name of an assignment.
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?!" + _TAIL + r")={0,2}"
CANDIDATE = "|".join([*FORMATS.values(), ASSIGNED, MIXED])
#: Words by which placeholders, identifiers and paths are told from random strings, and whose pairs of letters are those of words.
DICTIONARY = (
    "example sample placeholder changeme dummy test user name path file config value data index image static assets http section chapter page report version "
    "build release default module class function server client local host node time date your this that with from here none null true false "
    "about after again between before could every first great house large learn letter little might never number other people place point right should small "
    "sound still their there these thing think three through under water where which while world would write order number string object method return public "
    "private service request response account message content article product customer company market system program network "
    "para como pero todo esta este entre sobre desde hasta donde cuando porque tiempo mundo casa hombre mujer ciudad pueblo agua "
    "dans pour avec sont tout plus comme mais nous vous leur cette entre aussi temps monde maison homme femme ville "
    "und der die das nicht eine einer auch wird werden haben sich durch gegen unter zwischen zeit welt haus mann frau stadt wasser"
).split()
COMMON = "|".join(sorted({w for w in DICTIONARY if len(w) > 3}, key=lambda w: (-len(w), w)))
#: Characters of context kept on either side.
BEFORE, AFTER = 48, 24
#: Candidates whose places are added up together.
_BLOCK = 512


def transitions() -> list[float]:
    """log2 of how likely a letter follows another in the dictionary's words, by 26 times the first letter plus the second."""
    pairs = Counter(p for w in DICTIONARY for p in pairwise(w))
    after = Counter()
    for (x, _), n in pairs.items():
        after[x] += n
    letters = [chr(97 + i) for i in range(26)]
    return [math.log2((pairs[x, y] + 0.25) / (after[x] + 26 * 0.25)) for x in letters for y in letters]


def with_candidates(docs: DataFrame) -> DataFrame:
    """row (docs' columns), path, pieces (the text between candidates) and found: value, name, start, before and after of each candidate of text."""
    out = as_row(docs, F.col("source").cast("string").alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("whole"))
    out = out.withColumn("matches", F.regexp_extract_all("whole", F.lit(CANDIDATE), F.lit(0)))
    some = F.size("matches") > 0
    out = out.withColumn("pieces", F.when(some, F.split("whole", CANDIDATE, -1))).drop("whole")
    lengths = F.transform("matches", lambda v, i: (F.length(F.get("pieces", i)) + F.length(v)).cast("long"))
    # conditions name the arrays that lambdas look up: what is used twice is not worked out anew for each candidate
    out = out.withColumn("lengths", F.when(F.size("pieces") > 1, lengths))
    add = lambda a, b: a + b
    zero = F.lit(0).cast("long")
    # sums of whole blocks, then of the blocks before each: no candidate adds up more than a block
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size("lengths") - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice("lengths", b * _BLOCK + 1, _BLOCK), zero, add))
    out = out.withColumn("sums", F.when(F.size("lengths") > 0, sums))
    blocks = F.transform("sums", lambda _, b: F.aggregate(F.slice("sums", F.lit(1), b), zero, add))
    out = out.withColumn("blocks", F.when(F.size("sums") > 0, blocks))

    def found(match: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        start = F.get("blocks", block) + F.aggregate(F.slice("lengths", block * _BLOCK + 1, i - block * _BLOCK), zero, add) + F.length(F.get("pieces", i))
        name = F.regexp_extract(match, "^" + PREFIX, 0)  # of an assignment, the value is the candidate
        before = F.right(F.concat(F.get("pieces", i), name), F.lit(BEFORE))
        return F.struct(F.substring(match, F.length(name) + 1, F.length(match)).alias("value"), name.alias("name"), (start + F.length(name)).alias("start"), before.alias("before"), F.left(F.get("pieces", i + 1), F.lit(AFTER)).alias("after"))

    return out.withColumn("found", F.when((F.size("blocks") > 0) & (F.size("lengths") > 0) & (F.size("pieces") > 1), F.transform("matches", found))).drop("matches", "lengths", "sums", "blocks")


def kind(value: Column) -> Column:
    out = F.lit("token")
    for name, pattern in reversed(FORMATS.items()):
        out = F.when(value.rlike("^(?:" + pattern.replace(r"\b", "") + ")"), name).otherwise(out)
    return out


def features(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    part = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    lower = F.lower(value)
    chars = F.size(F.array_distinct(F.split(value, "")))
    beside = F.lower(before)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    covered = (n - F.length(F.regexp_replace(lower, COMMON, ""))) / n
    # what stands for a value: references, placeholders; what is a word
    reference = value.rlike(r"^(?:[$<{%*(\[]|[xX*.]{4,}$|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\W{0,2}$|[\w.]+[(\[])") & (kind(value) == "token")
    word = value.rlike(r"^[A-Za-z]?[a-z]{1,15}[.,;:!?)]{0,2}$")
    named = beside.rlike(NAMES + r"(?:s|[_.-]?key|[_.-]?value|orization|[_.-][a-z0-9_.-]*)?\W{0,6}(?:(?:bearer|basic|token|is|was)\W{1,3})?$")
    assigned = before.rlike(r"=\s?[\"']?$|[\"']\s{0,3}:\s{0,3}[\"']$|(?i:bearer|basic)\s+$")
    user = before.rlike(r"://[^\s/:@]*:$") & after.startswith("@")
    # pairs of letters that follow each other, by the codes of both; arrays are made once, not once a pair
    letters = F.split(lower, "")
    inside = lambda x: (x >= 97) & (x < 123)
    table = F.array(*(F.lit(x) for x in transitions()))
    pairs = F.zip_with(letters, F.slice(letters, 2, F.size(letters)), lambda x, y: F.when(inside(F.ascii(x)) & inside(F.ascii(y)), (F.ascii(x) - 97) * 26 + F.ascii(y) - 97))
    known = F.transform(F.array_compact(pairs), lambda i: F.get(table, i))
    likely = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known)).otherwise(-5.0)
    return {
        "length": n,
        "kinds": (F.regexp_count(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1) / n,
        "likely": likely,
        "letters": F.regexp_count(lower, F.lit("(?=[aeiou][b-df-hj-np-tv-z]|[b-df-hj-np-tv-z][aeiou])")) / n,
        "digits": part("[0-9]"),
        "capitals": part("[A-Z]"),
        "distinct": chars / n,
        "hexadecimal": yes(value.rlike("^[0-9a-f]+$")),
        "dashes": part("[-_]"),
        "covered": covered,
        "looks": F.when(reference, 0).when(word, 1).when((kind(value) != "token") & (covered < 0.2), 3).otherwise(2).cast("double"),
        "in_path": yes(value.contains("/") | F.right(before, F.lit(1)).isin("/", ".", "@", "\\") | after.rlike(r"^(?:\.[a-z]{2,4}\b|/|@)")),
        "test_path": yes(F.lower(path).rlike("test|fixture|example|sample|mock|docs?/")),
        "named": yes(named),
        "near_name": yes(beside.rlike(NAMES)),
        "harmless": yes(beside.rlike(r"(?:\b|[_.-])" + HARMLESS + r"\W{0,6}(?:(?:code|number|is|was)\W{1,3})?$") | value.rlike("^(?i:sha(?:1|256|384|512)-)")),
        "context": F.when(user, 3).when(named & assigned, 2).when(named, 1).otherwise(0).cast("double"),
    }


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """n findings made by rule: value, before, after, path, label."""
    row = spark.range(0, n, 1, 4).withColumn("h", F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 512))
    h = F.col("h")
    random64 = F.translate(F.base64(F.unhex(h)), "=", "")
    upper = F.upper(F.translate(F.translate(h, "01", "GZ"), "abcdef", "KQRTVX"))
    pick = lambda k, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    prose = pick(1, "and then the ", "as was said in ", "of the ", "", "para el que ", "dans les ", "und von der ", "line. ")
    name = pick(2, "password=", "secret: ", "token = \"", "api_key=", "Authorization: Bearer ", "passwd: ", "auth_token='")
    near = pick(3, "commit ", "sha256:", "md5 checksum ", "uuid ", "etag: ", "revision ", "order id ", "digest=")
    words = F.concat(pick(4, "section", "chapter", "report", "image", "module", "release"), pick(5, "Default", "_index_", "-version-", "Config", "Value"), pick(6, "Server2", "page10", "Test01", "node3", "file2024", "data7"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    number = F.substring(F.translate(h, "abcdef", "012345"), 1, 16)
    letters = F.translate(h, "0123456789", "ghijkmnpqr")
    alphabetic = F.translate(F.translate(random64, "0123456789", "ghKmNpQrSt"), "+/", "vW")
    word = pick(11, "hunter", "dragon", "monkey", "summer", "letmein", "winter", "admin", "Tr0ub4dor", "pa55word", "qwerty")
    short = F.concat(word, pick(12, "2", "42!", "#1", "2024", "_7", "!"), pick(13, "", "", "secret", "Pass", "x"))
    compound = pick(14, "DB_PASSWORD=", "\"password\": \"", "db.password = ", "SMTP_PASS=", "PGPASSWORD=", "client_secret=", "\"userPassword\":\"", "admin_pwd: ", "passphrase='", "?password=")
    keyed = pick(15, "AWS_SECRET_ACCESS_KEY=", "client_secret=", "access_token=", "\"refresh_token\": \"", "secretKey: ", "SECRET_KEY = '", "&access_token=", "azure_account_key=", "credentials: ", "private_key=")
    bearer = pick(16, "Authorization: Bearer ", "\"authorization\": \"Bearer ", "-H 'Authorization: Bearer ", "Bearer ", "proxy-authorization: Basic ")
    address = F.concat(pick(17, "postgres", "mysql", "mongodb+srv", "https", "amqp", "redis"), F.lit("://"), pick(18, "admin", "root", "app", "svc_user", "", "deploy"), F.lit(":"))
    host = F.concat(F.lit("@"), pick(19, "db.internal:5432/app", "localhost/x", "10.0.0.7:6379", "host"))
    body = F.concat_ws("\n", random64, F.reverse(random64), F.substring(random64, 1, 64))
    armour = lambda kind, head: F.concat(F.lit(f"-----BEGIN {kind}PRIVATE KEY-----\n"), head, body, F.lit(f"\n-----END {kind}PRIVATE KEY-----"))
    headers = F.concat(F.lit("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,"), F.substring(upper, 1, 32), F.lit("\n\n"))
    spoken = pick(20, "author: ", "tokenizer: ", "secretary: ", "the password: ", "authority: ", "token: ", "secret: ", "authors: ", "Authentication: ", "passwords: ")
    said = pick(21, "Johnson", "sentencepiece", "Margaret", "required", "optional,", "nobody", "invalid.", "Ministry", "whatever", "default", "because", "choose")
    stands = pick(22, "${DB_PASSWORD}", "<password>", "process.env.API_KEY", "os.environ['TOKEN']", "getpass.getpass()", "settings.SECRET_KEY", "********", "xxxxxxxx", "{{password}}", "$PASSWORD", "null,", "None", "config.get(", "%(password)s")
    query = pick(23, "?id=", "&ref=", "utm_campaign=", "page=", "&v=", "?session_date=", "name=")
    cases = [
        (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), prose),
        (1, F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(random64, "[+/]", "k"), 1, 36)), prose),
        (1, F.substring(h, 1, 18), F.concat(prose, pick(7, "password=", "passwd: ", "pwd=", "secret="))),
        (1, F.substring(h, 1, 40), F.concat(prose, pick(8, "token = \"", "api_key=", "secret: ", "auth: "))),
        (1, F.substring(random64, 1, 32), F.concat(prose, name)),
        (1, F.substring(random64, 5, 44), prose),
        (0, uuid, F.concat(prose, pick(9, "uuid ", "id: ", "", "request "))),
        (0, F.substring(h, 1, 40), F.concat(prose, near)),
        (0, F.substring(h, 1, 32), F.concat(prose, near)),
        (0, number, prose),
        (0, words, prose),
        (0, F.concat(F.lit("articles/"), words, F.lit("/view1")), F.concat(prose, F.lit("https://www.site.com/"))),
        (0, F.concat(F.lit("AKIA"), F.substring(upper, 1, 9), F.lit("EXAMPLE")), prose),
        (0, pick(10, "your_password_here1", "changeme1234", "xxxxxxxxxxxxxxxx1", "example-token-000", "placeholder_value_1"), F.concat(prose, name)),
        (1, short, F.concat(prose, compound)),
        (1, pick(24, "letmein", "correcthorse", "sunshine", "iloveyou", "trustno", "opensesame"), F.concat(prose, pick(25, "password=", "DB_PASSWORD=", "\"password\": \"", "passwd='"))),
        (1, F.substring(h, 1, 24), F.concat(prose, keyed)),
        (1, F.substring(h, 3, 40), F.concat(prose, keyed)),
        (1, F.substring(random64, 3, 40), F.concat(prose, keyed)),
        (1, F.concat(F.lit("AIza"), F.substring(F.translate(random64, "+/", "_-"), 1, 35)), F.concat(prose, pick(26, "?key=", "&key=", "", "apiKey: \""))),
        (1, F.substring(letters, 1, 26), F.concat(prose, bearer)),
        (1, F.substring(alphabetic, 1, 32), F.concat(prose, bearer)),
        (1, F.when(F.col("id") % 2 == 0, short).otherwise(pick(27, "pw", "hunter", "s3cr3t", "admin", "guest", "p%40ss")), F.concat(prose, address), host),
        (1, F.substring(random64, 2, 20), F.concat(prose, address), host),
        (1, armour("RSA ", headers), prose),
        (1, armour("", F.lit("")), prose),
        (0, said, F.concat(prose, spoken)),
        (0, stands, F.concat(prose, compound)),
        (0, pick(28, "${PASSWORD}", "<password>", "$PGPASS", "{password}", "****"), F.concat(prose, address), host),
        (0, words, F.concat(prose, query)),
        (0, uuid, F.concat(prose, query)),
        (0, number, F.concat(prose, query)),
        (1, F.concat(F.lit("SG."), F.substring(F.translate(alphabetic, "+/", "ab"), 1, 22), F.lit("."), F.substring(F.reverse(F.translate(random64, "+/", "_-")), 1, 43)), prose),
        (1, F.concat(pick(29, "hf_", "glpat-", "npm_", "sk-", "sk_live_", "pypi-"), F.substring(F.translate(alphabetic, "+/", "xy"), 1, 36)), F.concat(prose, pick(30, "", "token: ", "use "))),
        (1, F.concat(pick(31, "hf_", "glpat-", "npm_", "sk-ant-api03-", "sk-proj-", "rk_test_"), F.substring(F.translate(random64, "+/", "xy"), 1, 36)), prose),
        (1, F.concat(word, pick(32, "99", "7", "2024!", "_42", "123")), F.concat(prose, pick(33, "password is ", "the password was ", "passphrase is: ", "my passcode is "))),
        (1, F.concat(word, pick(42, "2", "99", "4u", "1"), pick(43, "secret", "house", "castle", "under", "water", "Pass")), F.concat(prose, compound)),
        (0, pick(44, "garden", "window", "teacher", "morning", "nothing", "everyone", "tonight", "missing", "expired", "wrong", "bicycle", "mountain"), F.concat(prose, pick(45, "the password: ", "a token: ", "the secret: ", "passwords: ", "author: ", "this password: "))),
        (0, F.concat(F.lit("iVBORw0KGgo"), random64), F.concat(prose, pick(34, "data:image/png;base64,", "url(data:font/woff2;base64,"))),
        (0, F.concat(pick(35, "sha512-", "sha384-", "sha256-"), random64), F.concat(prose, pick(36, "integrity=\"", "\"integrity\": \"", ""))),
        (0, F.substring(upper, 1, 16), F.concat(prose, pick(37, "product code ", "part ", "model ", "serial number ", "order ", "", "the "))),
        (0, F.substring(h, 1, 40), F.concat(prose, pick(38, "\"private_key_id\": \"", "secret_id=", "token_id: ", "\"api_key_id\": \"", "private_key_version: "))),
        (0, F.concat_ws("-", pick(39, "sk-learn", "sk-very-long", "npm-package", "hf-some"), pick(40, "with", "about", "under"), pick(41, "hyphenated-words-in-it", "many-parts-to-name")), prose),
    ]
    made = F.element_at(F.array(*(F.struct(F.lit(y).alias("label"), v.alias("value"), b.alias("before"), (after[0] if after else F.lit(" and so")).alias("after")) for y, v, b, *after in cases)), (F.col("id") % len(cases) + 1).cast("int"))
    path = F.when(F.col("id") % 11 == 0, "tests/fixture").otherwise(F.lit("src"))
    return row.select(made.alias("m"), path.alias("path")).select("m.value", F.right("m.before", F.lit(BEFORE)).alias("before"), F.left("m.after", F.lit(AFTER)).alias("after"), "path", F.col("m.label").cast("double").alias("label"))


class Forest:
    """Trained trees as a column expression over named features."""

    def __init__(self, names: list[str], trees: list[tuple]):
        self.names, self.trees = names, trees

    def score(self, of: dict[str, Column]) -> Column:
        """The mean of the trees' shares of secrets."""
        shares = [self._share(t, of) for t in self.trees]
        return sum(shares[1:], shares[0]) / F.lit(float(len(shares)))

    def _share(self, node: tuple, of: dict[str, Column]) -> Column:
        if len(node) == 1:
            return F.lit(node[0])
        feature, most, low, high = node
        return F.when(of[self.names[feature]] <= F.lit(most), self._share(low, of)).otherwise(self._share(high, of))


def _tree(node) -> tuple:
    """A trained node: (share of secrets) of a leaf, or (feature, most, lower, higher)."""
    if "LeafNode" in node.getClass().getName():
        clean, secret = node.impurityStats().stats()
        return (secret / (clean + secret),)
    return node.split().featureIndex(), node.split().threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 11) -> Forest:
    """A forest of labelled findings (value, before, after, path, label)."""
    of = features(F.col("value"), F.col("before"), F.col("after"), F.col("path"))
    rows = findings.select("label", *(c.alias(n) for n, c in of.items()))
    assembled = VectorAssembler(inputCols=list(of), outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=4).fit(assembled)
    return Forest(list(of), [_tree(t._java_obj.rootNode()) for t in model.trees])


def scanned(docs: DataFrame, forest: Forest, least: float = 0.4) -> DataFrame:
    """row (docs' columns), pieces and judged: value, name, start, kind, score and secret of each candidate; null where there is none."""
    held = with_candidates(spread(docs))
    measured = F.transform("found", lambda x: F.struct(*(x[n].alias(n) for n in ("value", "name", "start")), *(c.alias(n) for n, c in features(x["value"], x["before"], x["after"], F.col("path")).items())))
    held = held.withColumn("measured", F.when(F.col("found").isNotNull(), measured))
    scored = F.transform("measured", lambda x: F.struct(*(x[n].alias(n) for n in ("value", "name", "start")), kind(x["value"]).alias("kind"), forest.score({n: x[n] for n in forest.names}).alias("score")))
    held = held.withColumn("scored", F.when(F.col("measured").isNotNull(), scored))
    judged = F.transform("scored", lambda x: x.withField("secret", x["score"] > least))
    return held.select("row", "pieces", F.when(F.col("scored").isNotNull(), judged).alias("judged"))


def findings(docs: DataFrame, forest: Forest, least: float = 0.4) -> DataFrame:
    """A row per candidate of docs (doc_id, text, source): doc_id, kind, start, n_chars, value_sha256, score, secret."""
    # texts are left behind before candidates are rows: each would carry its text otherwise
    held = scanned(docs.select("doc_id", "text", "source"), forest, least).select(F.col("row.doc_id").alias("doc_id"), "judged")
    rows = held.select("doc_id", F.explode_outer("judged").alias("x")).where("x is not null")
    return rows.select("doc_id", "x.kind", "x.start", F.length("x.value").alias("n_chars"), F.sha2("x.value", 256).alias("value_sha256"), "x.score", "x.secret")


def redact(docs: DataFrame, forest: Forest, least: float = 0.4) -> DataFrame:
    """docs with each secret of text replaced by its kind in brackets."""
    held = scanned(docs, forest, least)
    parts = F.transform("judged", lambda x, i: F.concat(F.get("pieces", i), x["name"], F.when(x["secret"], F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise(x["value"])))
    text = F.concat(F.array_join(parts, ""), F.element_at("pieces", -1))
    return from_row(held, docs.columns, text=F.when(F.col("judged").isNotNull(), text).otherwise(F.col("row.text")))
