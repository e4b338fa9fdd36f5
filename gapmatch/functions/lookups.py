"""Constant lookup values (SRC-09) and helpers that turn them into DataFrames.

Everything between the FIXED VALUES markers must equal the behaviour we
reproduce (word lists, aliases, patterns, messages).  They are written as plain
text in their natural order; the helpers below only split that text.
"""

from __future__ import annotations



def _words(block: str) -> list[str]:
    return block.split()


def _lines(block: str) -> list[str]:
    return [ln.strip() for ln in block.strip().splitlines() if ln.strip()]


def _pairs(block: str, sep: str = " => ") -> list[tuple[str, str]]:
    out = []
    for ln in _lines(block):
        a, b = ln.split(sep)
        out.append((a, b))
    return out


# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reproduced behaviour; do not edit)
# ---------------------------------------------------------------------------

# Generic single-word verbs (one verb family per line).
GENERIC_VERBS_TEXT = """
analyze analyses analysed analyzed analyzing
build builds built building
create creates created creating
use uses used using
work works worked working
manage manages managed managing
develop develops developed developing
design designs designed designing
implement implements implemented implementing
support supports supported supporting
maintain maintains maintained maintaining
test tests tested testing
deploy deploys deployed deploying
monitor monitors monitored monitoring
review reviews reviewed reviewing
define defines defined defining
identify identifies identified identifying
prepare prepares prepared preparing
perform performs performed performing
provide provides provided providing
ensure ensures ensured ensuring
research researches researched researching
optimize optimizes optimized optimizing
automate automates automated automating
integrate integrates integrated integrating
extract extracts extracted extracting
transform transforms transformed transforming
load loads loaded loading
collect collects collected collecting
process processes processed processing
generate generates generated generating
present presents presented presenting
report reports reported reporting
lead leads led leading
coordinate coordinates coordinated coordinating
collaborate collaborates collaborated collaborating
communicate communicates communicated communicating
assist assists assisted assisting
troubleshoot troubleshoots troubleshooted troubleshooting
resolve resolves resolved resolving
configure configures configured configuring
install installs installed installing
update updates updated updating
migrate migrates migrated migrating
document documents documented documenting
train trains trained training
evaluate evaluates evaluated evaluating
apply applies applied applying
establish establishes established establishing
structure structures structured structuring
conduct conducts conducted conducting
"""

# Generic non-technical nouns / adjectives.
GENERIC_NON_SKILLS_TEXT = """
science technology engineering mathematics
information system systems solution solutions
data analysis analytics intelligence platform
service services application applications
management strategy strategies approach
model models framework frameworks
process processes workflow workflows
tool tools technique techniques
method methods methodology methodologies
project projects product products
team teams stakeholder stakeholders
requirement requirements specification specifications
document documents documentation
report reports presentation presentations
meeting meetings client clients
company companies organization organizations
industry field domain sector
experience background knowledge understanding
skill skills ability abilities capability
degree bachelor master phd certification
year years month months
responsible responsibilities role roles
task tasks activity activities
best practices good excellent strong
bachelor masters degree diploma
etc including using via based
related relevant various multiple
"""

# Company / platform names.
COMPANY_PLATFORM_NAMES_TEXT = """
google microsoft amazon apple facebook meta
linkedin twitter instagram bitbucket
slack trello asana notion
salesforce oracle sap ibm hp dell
netflix spotify uber airbnb shopify
zoom teams webex skype
adobe sketch canva
heroku vercel netlify cloudflare
stripe twilio sendgrid
coursera udemy edx pluralsight
"""

# Words that are ambiguous on their own.
AMBIGUOUS_SINGLE_WORDS_TEXT = """
natural language deep machine artificial
computer neural network networks
cloud web mobile desktop
front back full
large small big
transform extract pipeline
model algorithm library
query database server
security testing debugging
"""

# Recognised single-word skills.
ALLOWED_SINGLE_WORD_SKILLS_TEXT = """
python java javascript typescript sql r
scala kotlin swift go rust perl ruby
matlab html css bash shell powershell
c c++ c# .net node.js cobol fortran assembly
mysql postgresql mongodb redis sqlite
cassandra elasticsearch hbase neo4j dynamodb
pandas numpy scipy matplotlib seaborn plotly
tensorflow pytorch keras sklearn spacy scikit-learn
docker kubernetes terraform ansible jenkins
git github gitlab linux ubuntu debian bash
tableau excel powerpoint word powerbi
hadoop spark kafka airflow dbt
sklearn xgboost lightgbm catboost
flask django fastapi react angular vue
spark hive pig sqoop flume
snowflake redshift bigquery databricks
looker domo qlik
regex json xml yaml csv api
postman swagger graphql
jira confluence
scrum agile kanban
statistics probability calculus algebra
ml dl nlp cv js ts
aws gcp azure
"""

# Multi-word skills that are always accepted (one per line).
REQUIRED_MULTI_WORD_SKILLS_TEXT = """
machine learning
deep learning
natural language processing
computer vision
artificial intelligence
data science
data analysis
data engineering
data visualization
data modeling
data modelling
data mining
data wrangling
data cleaning
data pipelines
data warehouse
data lake
data governance
data quality
big data
exploratory data analysis
statistical analysis
statistical modeling
predictive modeling
predictive analytics
business intelligence
business analytics
extract transform load
etl pipeline
feature engineering
model deployment
a/b testing
ab testing
hypothesis testing
time series analysis
time series forecasting
anomaly detection
sentiment analysis
text mining
neural network
neural networks
random forest
decision tree
decision trees
support vector machine
support vector machines
linear regression
logistic regression
gradient boosting
reinforcement learning
transfer learning
dimensionality reduction
principal component analysis
cluster analysis
k-means clustering
microsoft excel
microsoft word
microsoft powerpoint
microsoft access
microsoft sql server
microsoft azure
microsoft office
google cloud platform
google analytics
google sheets
google bigquery
google data studio
amazon web services
amazon redshift
amazon s3
amazon ec2
amazon sagemaker
power bi
power bi desktop
power query
power automate
power apps
qlik sense
qlik view
looker studio
sql server
sql server management studio
sql server reporting services
ssrs
ssas
ssis
oracle database
oracle sql
postgresql database
version control
source control
continuous integration
continuous deployment
ci/cd
cicd
rest api
restful api
web scraping
web development
full stack development
front end development
back end development
object oriented programming
object-oriented programming
functional programming
agile methodology
scrum methodology
project management
product management
stakeholder management
risk management
change management
lean methodology
six sigma
critical thinking
problem solving
data storytelling
report writing
verbal communication
written communication
communication skills
team collaboration
cross functional
attention to detail
node.js
react.js
vue.js
scikit-learn
scikit learn
apache spark
apache kafka
apache hadoop
apache airflow
apache hive
"""

# Section header patterns: class, then one anchored pattern per line.  Classes
# are tried in this order and the first class with a matching pattern wins.
SECTION_PATTERNS_TEXT = r"""
skills => (?i)^(required\s+|desired\s+|preferred\s+)?(technical\s+)?skills?(\s+summary)?[\s:]*$
skills => (?i)^core\s+competenc(y|ies)[\s:]*$
skills => (?i)^technologies[\s:]*$
skills => (?i)^tools?\s+(and\s+technologies?)?[\s:]*$
skills => (?i)^tech\s+stack[\s:]*$
skills => (?i)^programming\s+languages?[\s:]*$
skills => (?i)^key\s+skills?[\s:]*$
skills => (?i)^software\s+skills?[\s:]*$
skills => (?i)^relevant\s+skills?[\s:]*$
skills => (?i)^expertise[\s:]*$
skills => (?i)^proficienc(y|ies)[\s:]*$
experience => (?i)^(work\s+|professional\s+|relevant\s+)?experience[\s:]*$
experience => (?i)^(key\s+|job\s+)?responsibilities[\s:]*$
experience => (?i)^employment(\s+history)?[\s:]*$
experience => (?i)^work\s+history[\s:]*$
experience => (?i)^career(\s+history)?[\s:]*$
experience => (?i)^positions?\s+held[\s:]*$
experience => (?i)^preferred[\s:]*$
projects => (?i)^(key\s+|major\s+|selected\s+)?projects?[\s:]*$
projects => (?i)^portfolio[\s:]*$
projects => (?i)^academic\s+projects?[\s:]*$
projects => (?i)^personal\s+projects?[\s:]*$
education => (?i)^education(\s+background)?[\s:]*$
education => (?i)^academic(\s+background)?[\s:]*$
education => (?i)^qualifications?[\s:]*$
education => (?i)^degrees?[\s:]*$
certifications => (?i)^certifications?(\s+and\s+training)?[\s:]*$
certifications => (?i)^licenses?\s+and\s+certifications?[\s:]*$
certifications => (?i)^credentials?[\s:]*$
certifications => (?i)^awards?\s+and\s+certifications?[\s:]*$
summary => (?i)^(professional\s+)?summary[\s:]*$
summary => (?i)^(professional\s+)?profile[\s:]*$
summary => (?i)^objective[\s:]*$
summary => (?i)^about[\s:]*$
summary => (?i)^overview[\s:]*$
summary => (?i)^role\s+summary[\s:]*$
"""

# Section class => display name.
SECTION_DISPLAY_TEXT = """
skills => Skills section
experience => Experience section
projects => Project section
education => Education section
certifications => Certifications section
summary => Summary section
body => General section
"""

# Display precedence of sections in evidence strings.
SECTION_ORDER_TEXT = """
Skills section
Experience section
Project section
Education section
Certifications section
Summary section
General section
"""

# Contact / social indicators searched around company names (regex, in order).
CONTACT_INDICATORS_TEXT = r"""
contact
reach\s+out
connect
follow
profile
account
linkedin
twitter
email
@
http
www\.
\.com
find\s+me
visit
check\s+out
"""

# Special symbol patterns => canonical term, tried in this order.
SPECIAL_PATTERNS_TEXT = r"""
(?i)(?<![\w#])c\+\+(?![\w+]) => c++
(?i)(?<![\w#])c#(?![\w#]) => c#
(?i)(?<!\w)\.net\b => .net
(?i)(?<!\w)node\.js\b => node.js
(?i)(?<!\w)react\.js\b => react
(?i)(?<!\w)vue\.js\b => vue.js
(?i)\br\b(?=\s*(?:programming|language|script|code|studio|\,|$)) => r
(?i)\bc\b(?=\s*(?:programming|language|compiler|\,|$)) => c
"""

# Short acronyms scanned as whole words (only those that are alias keys count).
ACRONYM_CANDIDATES_TEXT = "aws sql ml dl nlp js ts r bi"

# Default alias map: alias => canonical.
DEFAULT_ALIASES_TEXT = """
ml => machine learning
machine-learning => machine learning
machinelearning => machine learning
dl => deep learning
deep-learning => deep learning
deeplearning => deep learning
nlp => natural language processing
natural-language-processing => natural language processing
cv => computer vision
computer-vision => computer vision
ai => artificial intelligence
js => javascript
ts => typescript
py => python
ms excel => microsoft excel
excel => microsoft excel
ms-excel => microsoft excel
ms word => microsoft word
word => microsoft word
powerbi => power bi
power-bi => power bi
power bi desktop => power bi
sql server => microsoft sql server
ms sql => microsoft sql server
mssql => microsoft sql server
amazon web services => aws
amazon aws => aws
aws => aws
gcp => google cloud platform
google cloud => google cloud platform
azure => microsoft azure
ms azure => microsoft azure
postgres => postgresql
k8s => kubernetes
tf => tensorflow
tensor flow => tensorflow
sklearn => scikit-learn
scikit learn => scikit-learn
git hub => github
ci/cd => cicd
ci cd => cicd
bi => business intelligence
eda => exploratory data analysis
reactjs => react
react.js => react
nodejs => node.js
node js => node.js
vuejs => vue.js
vue js => vue.js
"""

# Display-name overrides: lowercased skill => display.
DISPLAY_OVERRIDES_TEXT = """
aws => AWS
sql => SQL
power bi => Power BI
numpy => NumPy
pandas => Pandas
python => Python
tableau => Tableau
microsoft excel => Microsoft Excel
machine learning => Machine Learning
data visualization => Data Visualization
statistics => Statistics
c++ => C++
c# => C#
.net => .NET
node.js => Node.js
react => React
scikit-learn => scikit-learn
html => HTML
css => CSS
r => R
ci/cd => CI/CD
cicd => CI/CD
gcp => GCP
business intelligence => Business Intelligence
deep learning => Deep Learning
natural language processing => Natural Language Processing
computer vision => Computer Vision
artificial intelligence => Artificial Intelligence
data science => Data Science
data analysis => Data Analysis
data modeling => Data Modeling
data engineering => Data Engineering
etl => ETL
extract transform load => Extract Transform Load
"""

# Fallback dictionary used when no knowledge base is available.
FALLBACK_SKILLS_TEXT = """
python
java
c++
c#
javascript
typescript
r
sql
html
css
machine learning
deep learning
natural language processing
computer vision
data analysis
data science
microsoft excel
power bi
tableau
docker
kubernetes
git
github
aws
amazon web services
google cloud platform
microsoft azure
pytorch
tensorflow
scikit-learn
pandas
numpy
react
node.js
data visualization
statistics
business intelligence
"""

# Curated skills: name | category | skill type | hot | in demand.
CURATED_SKILLS_TEXT = """
machine learning | Software & AI | software | Y | Y
deep learning | Software & AI | software | Y | Y
natural language processing | Software & AI | software | Y | Y
computer vision | Software & AI | software | Y | Y
data analysis | Data & Analytics | software | Y | Y
data science | Data & Analytics | software | Y | Y
data engineering | Data & Analytics | software | Y | Y
data visualization | Data & Analytics | software | Y | Y
statistics | Data & Analytics | essential | Y | Y
microsoft excel | Office & Productivity | software | Y | Y
cloud computing | Infrastructure | software | Y | Y
big data | Data & Analytics | software | Y | N
web development | Software Development | software | N | N
frontend development | Software Development | software | N | N
backend development | Software Development | software | N | N
full stack development | Software Development | software | Y | Y
devops | DevOps & Cloud | software | Y | Y
git | Version Control | software | Y | Y
github | Version Control | software | Y | Y
docker | Containerization | software | Y | Y
kubernetes | Containerization | software | Y | Y
rest api | Software Development | software | Y | Y
graphql | Software Development | software | N | N
scikit-learn | Data & Analytics | software | Y | Y
tensorflow | Machine Learning | software | Y | Y
pytorch | Machine Learning | software | Y | Y
pandas | Data & Analytics | software | Y | Y
numpy | Data & Analytics | software | Y | Y
matplotlib | Data & Analytics | software | N | N
seaborn | Data & Analytics | software | N | N
tableau | Business Intelligence | software | Y | Y
power bi | Business Intelligence | software | Y | Y
sql | Database | software | Y | Y
nosql | Database | software | Y | Y
mongodb | Database | software | Y | Y
postgresql | Database | software | Y | Y
mysql | Database | software | Y | Y
redis | Database | software | N | N
amazon web services | Cloud | software | Y | Y
aws | Cloud | software | Y | Y
azure | Cloud | software | Y | Y
microsoft azure | Cloud | software | Y | Y
gcp | Cloud | software | Y | Y
google cloud platform | Cloud | software | Y | Y
linux | Operating Systems | software | Y | N
c++ | Programming Languages | software | Y | Y
c# | Programming Languages | software | Y | Y
.net | Software Frameworks | software | Y | Y
node.js | Software Frameworks | software | Y | Y
react | Software Frameworks | software | Y | Y
angular | Software Frameworks | software | Y | N
vue.js | Software Frameworks | software | N | N
javascript | Programming Languages | software | Y | Y
typescript | Programming Languages | software | Y | Y
python | Programming Languages | software | Y | Y
java | Programming Languages | software | Y | Y
problem solving | Essential Skill | essential | N | Y
communication | Essential Skill | essential | N | Y
teamwork | Essential Skill | essential | N | Y
leadership | Essential Skill | essential | N | Y
time management | Essential Skill | essential | N | N
critical thinking | Essential Skill | essential | N | Y
agile | Project Management | essential | Y | Y
scrum | Project Management | essential | Y | N
"""

# English stop words of the word tokenizer.
STOP_WORDS_TEXT = """
a an the and or in on at to for with by about
against between into through during before after above below
from up down of off over under again further then once
here there when where why how all any both each few
more most other some such no nor not only own same
so than too very s t can will just don should now
i me my myself we our ours ourselves you your yours
he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this
that these those am is are was were be been being
have has had having do does did doing
"""

# Stop words of the TF-IDF vectorizer: the default English list of Spark ML's
# StopWordsRemover.
VECTORIZER_STOP_WORDS_TEXT = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will just don
should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't
haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's
why's would
"""

# Gap levels: lower bound | level | description (tried from the top).
GAP_LEVELS_TEXT = """
80.0 | Strong Match | Candidate possesses almost all mandatory skills for this role.
60.0 | Good Match | Candidate meets majority of requirements with minor skill gaps.
40.0 | Moderate Gap | Candidate meets foundational skills but is missing key core technologies.
0.0 | Large Gap | Substantial gap between candidate profile and role requirements.
"""

PRIORITY_HIGH = "High Priority"
PRIORITY_MEDIUM = "Medium Priority"
PRIORITY_LOW = "Low Priority"
REASON_HOT_AND_DEMAND = "Flagged as an O*NET Hot Technology and In-Demand skill across industries."
REASON_HOT = "Classified as an O*NET Hot Technology frequently required in recent job postings."
REASON_DEMAND = "Marked as high-growth and In-Demand in the O*NET database."
REASON_IMPORTANCE = "Essential competency with high O*NET importance rating ({importance}/5.0)."
REASON_MEDIUM = "Standard technical requirement associated with multiple occupations in O*NET (frequency: {count})."
REASON_LOW = "Role-specific or specialized technical skill."

STATUS_NO_PAGES = "The uploaded PDF document contains 0 pages."
STATUS_NO_TEXT = (
    "No selectable text found in the PDF. The document may be a scanned image "
    "or flattened raster file. Note: OCR (Optical Character Recognition) is not "
    "implemented. Please upload a text-based PDF or copy/paste text directly."
)

SIMILARITY_EMPTY_MSG = "One or both documents contain insufficient textual content."
SIMILARITY_NO_OVERLAP_MSG = "No significant shared vocabulary detected."
SIMILARITY_PREFIX_MSG = "Calculated via TF-IDF (1-2 n-grams) and Cosine Similarity in vector space. Top shared terms: "
SIMILARITY_EMPTY_VOCAB_MSG = "Error calculating TF-IDF similarity: empty vocabulary; perhaps the documents only contain stop words"

STATUS_MATCHED = "✓ Matched"
STATUS_MISSING = "✗ Missing"
STATUS_EXTRA = "+ Extra"
EVIDENCE_DEFAULT_MATCHED = "Detected in resume"
EVIDENCE_DEFAULT_EXTRA = "Skills section"
EVIDENCE_MISSING = "not detected"

DEFAULT_CATEGORY_EXTRACTED = "Software & Technology"
DEFAULT_CATEGORY_MISSING = "General Skill"
ESSENTIAL_CATEGORY = "Essential Skill"

FUZZY_THRESHOLD = 90.0
TFIDF_MAX_FEATURES = 5000
TOP_SHARED_TERMS = 10
EXPLAIN_TERMS = 5
CONTEXT_WINDOW = 60

# ---------------------------------------------------------------------------
# END FIXED VALUES
# ---------------------------------------------------------------------------

GENERIC_VERBS = frozenset(_words(GENERIC_VERBS_TEXT))
GENERIC_NON_SKILLS = frozenset(_words(GENERIC_NON_SKILLS_TEXT))
COMPANY_PLATFORM_NAMES = frozenset(_words(COMPANY_PLATFORM_NAMES_TEXT))
AMBIGUOUS_SINGLE_WORDS = frozenset(_words(AMBIGUOUS_SINGLE_WORDS_TEXT))
BLOCKLIST = GENERIC_VERBS | GENERIC_NON_SKILLS | COMPANY_PLATFORM_NAMES | AMBIGUOUS_SINGLE_WORDS
ALLOWED_SINGLE = frozenset(_words(ALLOWED_SINGLE_WORD_SKILLS_TEXT))
REQUIRED_MULTI = frozenset(_lines(REQUIRED_MULTI_WORD_SKILLS_TEXT))
SECTION_PATTERNS = _pairs(SECTION_PATTERNS_TEXT)
SECTION_DISPLAY = dict(_pairs(SECTION_DISPLAY_TEXT))
SECTION_ORDER = _lines(SECTION_ORDER_TEXT)
CONTACT_INDICATORS = _lines(CONTACT_INDICATORS_TEXT)
SPECIAL_PATTERNS = _pairs(SPECIAL_PATTERNS_TEXT)
ACRONYM_CANDIDATES = _words(ACRONYM_CANDIDATES_TEXT)
DEFAULT_ALIASES = _pairs(DEFAULT_ALIASES_TEXT)
DISPLAY_OVERRIDES = _pairs(DISPLAY_OVERRIDES_TEXT)
FALLBACK_SKILLS = _lines(FALLBACK_SKILLS_TEXT)
STOP_WORDS = frozenset(_words(STOP_WORDS_TEXT))
VECTORIZER_STOP_WORDS = tuple(_words(VECTORIZER_STOP_WORDS_TEXT))
GAP_LEVELS = [
    (float(lo), level, desc)
    for lo, level, desc in (tuple(p.strip() for p in ln.split("|")) for ln in _lines(GAP_LEVELS_TEXT))
]


def curated_skills() -> list[tuple[str, str, str, bool, bool]]:
    out = []
    for ln in _lines(CURATED_SKILLS_TEXT):
        name, cat, stype, hot, dem = (p.strip() for p in ln.split("|"))
        out.append((name, cat, stype, hot == "Y", dem == "Y"))
    return out


def section_classes() -> list[tuple[str, str]]:
    """(class, one alternation regex) in precedence order."""
    order: list[str] = []
    pats: dict[str, list[str]] = {}
    for cls, pat in SECTION_PATTERNS:
        if cls not in pats:
            order.append(cls)
            pats[cls] = []
        pats[cls].append(pat.replace("(?i)", "", 1))
    return [(c, "(?i)(?:" + "|".join("(?:" + p + ")" for p in pats[c]) + ")") for c in order]


def aliases_df(spark):
    """Default aliases as a DataFrame (alias, canonical, priority=0, ord)."""
    rows = [(a, c, 0, i) for i, (a, c) in enumerate(DEFAULT_ALIASES)]
    return spark.createDataFrame(rows, "alias string, canonical string, priority int, ord int")


def fallback_kb_df(spark):
    rows = [(s,) for s in FALLBACK_SKILLS]
    return spark.createDataFrame(rows, "skill_key string")
