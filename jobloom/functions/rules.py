"""Word lists, lookup tables, patterns and thresholds.

All are plain data that results depend on. Tables that users extend (technology
patterns, job boards, translations, cleaning profiles) have editable copies in
``jobloom.functions.registries``.
"""

from __future__ import annotations

# ---- translations (fixed values) ----

LOCATIONS = {
    "София": "Sofia",
    "Пловдив": "Plovdiv",
    "Варна": "Varna",
    "Бургас": "Burgas",
    "Русе": "Ruse",
    "Стара Загора": "Stara Zagora",
    "Плевен": "Pleven",
    "Дистанционно": "Remote",
    "Хибридно": "Hybrid",
    "Fully Remote": "Remote",
}

WORK_MODELS = {
    "Дистанционно": "remote",
    "Хибридно": "hybrid",
    "В офиса": "on-site",
    "Remote": "remote",
    "Hybrid": "hybrid",
    "On-site": "on-site",
}

JOB_TERMS = {
    "Разработчик": "Developer",
    "Програмист": "Programmer",
    "Инженер": "Engineer",
    "Старши": "Senior",
    "Младши": "Junior",
    "Лидер": "Lead",
    "Архитект": "Architect",
    "Бекенд": "Backend",
    "Фронтенд": "Frontend",
    "Фулстак": "Full-stack",
}

# Bulgarian months, January first (fixed values)
MONTHS = [
    "януари", "февруари", "март", "април", "май", "юни",
    "юли", "август", "септември", "октомври", "ноември", "декември",
]

# ---- technologies: name -> substrings that count as a mention (fixed values) ----

TECH_PATTERNS = {
    "java": ["java"],
    "spring": ["spring"],
    "hibernate": ["hibernate"],
    "maven": ["maven"],
    "gradle": ["gradle"],
    "mysql": ["mysql"],
    "postgresql": ["postgresql"],
    "docker": ["docker"],
    "kubernetes": ["kubernetes"],
    "aws": ["aws"],
    "git": ["git"],
    "jenkins": ["jenkins"],
    "junit": ["junit"],
    "rest": ["rest"],
    "api": ["api"],
    "microservices": ["microservices"],
    "react": ["react"],
    "angular": ["angular"],
    "vue": ["vue"],
    "node": ["nodejs", "node.js"],
    "typescript": ["typescript", "ts"],
    "javascript": ["javascript", "js"],
    "python": ["python"],
    "django": ["django"],
    "flask": ["flask"],
    "mongodb": ["mongodb", "mongo"],
    "redis": ["redis"],
    "elasticsearch": ["elasticsearch", "elastic"],
    "kafka": ["kafka"],
    "rabbitmq": ["rabbitmq", "rabbit"],
}

TECH_CATEGORIES = {
    "backend": ["java", "spring", "hibernate", "node", "python", "django", "flask"],
    "frontend": ["react", "angular", "vue", "javascript", "typescript"],
    "database": ["mysql", "postgresql", "mongodb", "redis", "elasticsearch"],
    "devops": ["docker", "kubernetes", "aws", "jenkins", "git"],
    "messaging": ["kafka", "rabbitmq"],
    "testing": ["junit"],
    "build": ["maven", "gradle"],
}

# display category -> substrings, first matching category wins (fixed values)
DISPLAY_CATEGORIES = {
    "Programming Languages": [
        "javascript", "typescript", "python", "java", "c#", "php", "ruby", "go", "rust", "swift", "kotlin", "scala",
    ],
    "Frameworks & Libraries": [
        "react", "angular", "vue", "express", "django", "spring", "laravel", "rails", "flask", ".net", "nextjs",
        "gatsby",
    ],
    "Databases": [
        "mysql", "postgresql", "mongodb", "redis", "elasticsearch", "oracle", "sqlite", "cassandra", "dynamodb",
    ],
    "Tools & Platforms": [
        "docker", "kubernetes", "jenkins", "git", "aws", "azure", "gcp", "terraform", "ansible", "webpack", "babel",
        "nginx",
    ],
}

# ---- job boards (fixed values) ----

BOARD_NAMES = [
    "DEV.BG", "dev.bg", "Indeed", "LinkedIn", "Glassdoor", "Jobs.bg", "AngelList", "Stack Overflow",
    "JobBoardFinder", "CareerBuilder", "Monster", "ZipRecruiter", "SimplyHired", "Dice", "IT Jobs", "JobServe",
]

BOARD_DOMAINS = [
    "dev.bg", "indeed.com", "linkedin.com", "glassdoor.com", "jobs.bg", "angel.co", "stackoverflow.com",
    "jobboardfinder.com", "careerbuilder.com", "monster.com", "ziprecruiter.com", "simplyhired.com", "dice.com",
    "itjobs.bg",
]

PROFILE_BOARD = "dev.bg"

# words that cannot be a company name taken from a job URL, and two special spellings (fixed values)
GENERIC_NAMES = [
    "senior", "junior", "developer", "engineer", "java", "react", "node", "js", "full", "stack", "middle", "lead",
]
SPECIAL_NAMES = {"recruitment bg": "Recruitment.bg", "technologica": "TechnoLogica"}

# hours a stored page stays fresh (fixed values)
FRESH_HOURS = {"dev.bg": 24 * 30, "company_website": 24 * 7}
FRESH_HOURS_OTHER = 24 * 14

# ---- language detection: stop words in priority order of the languages (fixed values) ----

STOP_WORDS = {
    "en": (
        "the and for are but not you all can had her was one our out day get has him his how its may new now old "
        "see two way who boy did man end few got let put too use"
    ).split(),
    "bg": (
        "за от до на или като може има това тази този които която което един една едно много малко добре лошо сега "
        "тогава където защо как кога"
    ).split(),
    "de": (
        "der die das und ist sie ich mit den auf für von dem des ein eine aber auch nach über nur noch wie aus bei "
        "vor durch ohne gegen zwischen"
    ).split(),
    "fr": (
        "le de et un il être et en avoir que pour dans ce son une sur avec ne se pas tout plus par grand en me même "
        "lui nos comme mais"
    ).split(),
}

# ---- text cleaning (fixed values) ----

NOISE_WORDS = [
    "cookies?|privacy policy|terms of service|gdpr|accept|decline",
    "subscribe|newsletter|follow us|social media",
    "share|like|tweet|facebook|linkedin|twitter",
    "advertisement|sponsored|promoted",
]

PRIORITY_PATTERNS = [
    "job.{0,20}(title|position|role)",
    "responsibilit(y|ies)",
    "requirement(s)?",
    "qualifications?",
    "experience",
    "salary|compensation|pay",
    "benefit(s)?",
    "location",
    "remote|hybrid|office",
]

# phrases scanned in company page text (fixed values)
TECH_PHRASES = [
    "JavaScript", "Java", "Python", "C#", "C++", "Go", "Rust", "PHP", "Ruby", "Swift", "Kotlin",
    "React", "Angular", "Vue.js", "Node.js", "Express", "Spring", "Django", "Flask", ".NET",
    "AWS", "Azure", "Google Cloud", "Docker", "Kubernetes", "Jenkins", "Git", "GitLab",
    "PostgreSQL", "MySQL", "MongoDB", "Redis", "ElasticSearch", "Kafka", "RabbitMQ",
    "Linux", "Ubuntu", "CentOS", "Windows", "MacOS",
]

BENEFIT_PHRASES = [
    "health insurance", "dental insurance", "life insurance",
    "remote work", "flexible hours", "work from home", "hybrid work",
    "paid time off", "vacation days", "annual leave",
    "bonus", "performance bonus", "annual bonus",
    "training", "courses", "conferences", "certifications",
    "gym membership", "fitness", "sports card",
    "free lunch", "free breakfast", "kitchen", "snacks",
    "parking", "transport allowance", "company car",
    "team building", "team events", "parties",
    "mentorship", "career development", "growth opportunities",
]

PROFILE_BENEFIT_PHRASES = [
    "health insurance", "dental", "vision", "medical",
    "remote work", "flexible hours", "work from home",
    "vacation", "paid time off", "holidays",
    "bonus", "equity", "stock options",
    "training", "learning", "development",
    "gym", "fitness", "wellness",
    "free lunch", "snacks", "coffee",
    "parking", "transport", "public transport",
]

INDUSTRY_WORDS = {
    "fintech": "Financial Technology",
    "finance": "Financial Services",
    "banking": "Banking",
    "software": "Software Development",
    "technology": "Technology",
    "consulting": "Consulting",
    "e-commerce": "E-commerce",
    "gaming": "Gaming",
    "healthcare": "Healthcare",
    "logistics": "Logistics",
    "education": "Education",
    "media": "Media & Entertainment",
}

CITIES = ["Sofia", "Plovdiv", "Varna", "Burgas", "Stara Zagora", "Pleven", "Ruse"]

SITE_LINK_EXCLUDED = [
    "dev.bg", "linkedin.com", "facebook.com", "twitter.com", "instagram.com", "youtube.com", "jobs.bg",
    "indeed.com", "glassdoor.com", "jobboardfinder.com",
]

JOB_LINK_EXCLUDED = [
    "dev.bg", "linkedin.com", "facebook.com", "twitter.com", "jobs.bg", "jobboardfinder.com", "indeed.com",
    "glassdoor.com",
]

TEXT_LINK_EXCLUDED = ["dev.bg", "linkedin.com", "facebook.com", "jobboardfinder.com", "indeed.com", "glassdoor.com"]

NETWORKS = {
    "facebook": "facebook.com",
    "linkedin": "linkedin.com",
    "instagram": "instagram.com",
    "youtube": "youtube.com",
    "twitter": "twitter.com",
    "github": "github.com",
}

# ---- extraction replies (fixed values) ----

REPLY_FIELDS = {
    "title": "text", "company": "text", "location": "text", "salaryMin": "number", "salaryMax": "number",
    "currency": "text", "experienceLevel": "text", "employmentType": "text", "workModel": "text",
    "description": "text", "requirements": "list", "responsibilities": "list", "technologies": "list",
    "benefits": "list", "educationLevel": "text", "industry": "text", "teamSize": "text", "companySize": "text",
    "applicationDeadline": "text", "postedDate": "text",
}
REPLY_SCORES = ["confidenceScore", "qualityScore"]
SOURCE_TYPES = ["job_board", "company_website", "social_media", "other"]
