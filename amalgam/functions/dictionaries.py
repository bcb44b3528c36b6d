"""Dictionaries, tables and patterns that results depend on, in the order that matters."""

from __future__ import annotations

# ---- Fixed values below: stated as they must be for the right results. ----

#: Skill alias -> canonical name. The order is that in which keywords found in prose are reported.
SKILLS = {
    "python": "Python", "py": "Python", "python3": "Python", "javascript": "JavaScript", "js": "JavaScript", "typescript": "TypeScript",
    "ts": "TypeScript", "java": "Java", "c++": "C++", "cpp": "C++", "c#": "C#", "csharp": "C#", "go": "Go", "golang": "Go", "rust": "Rust",
    "ruby": "Ruby", "php": "PHP", "swift": "Swift", "kotlin": "Kotlin", "scala": "Scala", "r": "R", "matlab": "MATLAB", "sql": "SQL",
    "mysql": "MySQL", "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "sqlite": "SQLite", "mongodb": "MongoDB", "mongo": "MongoDB",
    "redis": "Redis", "elasticsearch": "Elasticsearch", "react": "React", "reactjs": "React", "react.js": "React", "vue": "Vue.js", "vuejs": "Vue.js",
    "vue.js": "Vue.js", "angular": "Angular", "angularjs": "Angular", "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js",
    "express": "Express.js", "expressjs": "Express.js", "django": "Django", "flask": "Flask", "fastapi": "FastAPI", "spring": "Spring",
    "springboot": "Spring Boot", "spring boot": "Spring Boot", "docker": "Docker", "kubernetes": "Kubernetes", "k8s": "Kubernetes", "aws": "AWS",
    "amazon web services": "AWS", "gcp": "GCP", "google cloud": "GCP", "azure": "Azure", "microsoft azure": "Azure", "terraform": "Terraform",
    "ansible": "Ansible", "jenkins": "Jenkins", "git": "Git", "github": "GitHub", "gitlab": "GitLab", "linux": "Linux", "bash": "Bash",
    "shell": "Shell Scripting", "shell scripting": "Shell Scripting", "machine learning": "Machine Learning", "ml": "Machine Learning",
    "deep learning": "Deep Learning", "dl": "Deep Learning", "nlp": "NLP", "natural language processing": "NLP", "computer vision": "Computer Vision",
    "cv": "Computer Vision", "tensorflow": "TensorFlow", "pytorch": "PyTorch", "scikit-learn": "scikit-learn", "sklearn": "scikit-learn",
    "pandas": "Pandas", "numpy": "NumPy", "spark": "Apache Spark", "apache spark": "Apache Spark", "kafka": "Apache Kafka",
    "apache kafka": "Apache Kafka", "hadoop": "Hadoop", "rest": "REST API", "rest api": "REST API", "restful": "REST API", "graphql": "GraphQL",
    "microservices": "Microservices", "ci/cd": "CI/CD", "cicd": "CI/CD", "agile": "Agile", "scrum": "Scrum", "html": "HTML", "css": "CSS",
    "html/css": "HTML/CSS", "sass": "Sass", "tailwind": "Tailwind CSS", "tailwindcss": "Tailwind CSS", "next.js": "Next.js", "nextjs": "Next.js",
    "figma": "Figma", "system design": "System Design", "data structures": "Data Structures", "algorithms": "Algorithms",
    "object oriented programming": "OOP", "oop": "OOP", "functional programming": "Functional Programming",
}

#: Country name -> code.
COUNTRIES = {
    "United States": "US", "United States of America": "US", "USA": "US", "US": "US", "U.S.": "US", "U.S.A.": "US", "India": "IN", "IN": "IN",
    "United Kingdom": "GB", "UK": "GB", "England": "GB", "Britain": "GB", "Great Britain": "GB", "Canada": "CA", "CA": "CA", "Australia": "AU",
    "AU": "AU", "Germany": "DE", "DE": "DE", "France": "FR", "FR": "FR", "Netherlands": "NL", "NL": "NL", "Holland": "NL", "Singapore": "SG",
    "SG": "SG", "Japan": "JP", "JP": "JP", "China": "CN", "CN": "CN", "South Korea": "KR", "Korea": "KR", "KR": "KR", "Brazil": "BR", "BR": "BR",
    "Mexico": "MX", "MX": "MX", "Ireland": "IE", "IE": "IE", "Sweden": "SE", "SE": "SE", "Norway": "NO", "NO": "NO", "Denmark": "DK", "DK": "DK",
    "Switzerland": "CH", "CH": "CH", "Spain": "ES", "ES": "ES", "Italy": "IT", "IT": "IT", "Poland": "PL", "PL": "PL", "New Zealand": "NZ",
    "NZ": "NZ", "Israel": "IL", "IL": "IL", "UAE": "AE", "United Arab Emirates": "AE", "AE": "AE", "Pakistan": "PK", "PK": "PK", "Bangladesh": "BD",
    "BD": "BD", "Nigeria": "NG", "NG": "NG", "South Africa": "ZA", "ZA": "ZA", "Argentina": "AR", "AR": "AR", "Colombia": "CO", "CO": "CO",
    "Chile": "CL", "CL": "CL", "Portugal": "PT", "PT": "PT", "Belgium": "BE", "BE": "BE", "Austria": "AT", "AT": "AT", "Finland": "FI", "FI": "FI",
    "Remote": "REMOTE", "remote": "REMOTE",
}

MONTHS = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
    "january": "01", "february": "02", "march": "03", "april": "04", "june": "06", "july": "07", "august": "08", "september": "09", "october": "10",
    "november": "11", "december": "12",
}
ONGOING = ("present", "current", "now", "ongoing")

#: Sources from the most to the least trusted.
SOURCES = ("ats_json", "csv", "github_url", "resume_pdf", "resume_docx", "recruiter_txt", "linkedin_url")
UNKNOWN_PRIORITY = 99

#: Confidence of a source or a method, of an unknown source, and of an unknown method.
CONFIDENCE = {
    "ats_json": 0.95, "csv": 0.90, "github_url": 0.85, "resume_pdf": 0.75, "resume_docx": 0.75, "recruiter_txt": 0.60, "multiple": 0.80,
    "direct": 0.85, "direct+normalize": 0.85, "direct+normalize(E164)": 0.85, "keyword_match+canonicalize": 0.70, "nlp": 0.65, "regex": 0.80,
    "union+date_normalize": 0.70, "union": 0.70, "field_map": 0.90,
}
UNKNOWN_SOURCE, UNKNOWN_METHOD, METHOD_LEVEL, METHOD_SHARE, SEVERAL, KEYWORD = 0.70, 0.0, 0.80, 0.1, 0.05, 0.90
FIELD_WEIGHTS = {
    "full_name": 2.0, "emails": 2.0, "phones": 1.5, "location": 1.0, "skills": 1.5, "experience": 1.5, "education": 1.0, "headline": 0.5,
    "years_experience": 0.5, "links": 0.5,
}

#: File extension -> source type.
EXTENSIONS = {"csv": "csv", "json": "ats_json", "pdf": "resume_pdf", "docx": "resume_docx", "doc": "resume_docx", "txt": "recruiter_txt"}

#: Spreadsheet header (lower case) -> field.
CSV_FIELDS = {
    "name": "full_name", "full_name": "full_name", "email": "emails", "email_address": "emails", "phone": "phones", "phone_number": "phones",
    "current_company": "company", "company": "company", "title": "title", "job_title": "title", "location": "location_raw", "city": "location_raw",
    "linkedin": "linkedin_url", "linkedin_url": "linkedin_url", "github": "github_url", "github_url": "github_url", "headline": "headline", "skills": "skills_raw",
}

#: HR-system key -> field; of several keys of a field the last one present wins.
ATS_FIELDS = {
    "firstName": "first_name", "lastName": "last_name", "fullName": "full_name", "name": "full_name", "candidateName": "full_name",
    "email": "emails", "emailAddress": "emails", "email_address": "emails", "phone": "phones", "phoneNumber": "phones", "mobile": "phones",
    "location": "location_raw", "address": "location_raw", "city": "location_raw", "linkedinUrl": "linkedin_url", "linkedin": "linkedin_url",
    "githubUrl": "github_url", "github": "github_url", "headline": "headline", "currentTitle": "headline", "jobTitle": "headline",
    "skills": "skills_raw", "skillSet": "skills_raw", "experience": "experience", "workHistory": "experience", "education": "education",
}
#: Keys of an entry in an HR system's lists; of several keys the first one that isn't empty wins.
ATS_SKILL = ("name", "skill", "title")
ATS_EXPERIENCE = {"company": ("company", "organization"), "title": ("title", "role", "position"), "start": ("start", "startDate"), "end": ("end", "endDate"), "summary": ("summary", "description")}
ATS_EDUCATION = {"institution": ("institution", "school", "university"), "degree": ("degree", "qualification"), "field": ("field", "major", "fieldOfStudy"), "end_year": ("end_year", "graduationYear", "year")}

#: Place in a text (lower case) -> region whose dialling rules apply; the first one that occurs wins.
REGION_HINTS = {
    "india": "IN", "mumbai": "IN", "delhi": "IN", "bangalore": "IN", "bengaluru": "IN", "united states": "US", "usa": "US", "united kingdom": "GB", "uk": "GB",
    "london": "GB", "canada": "CA", "australia": "AU",
}
DEFAULT_REGION = "US"

SECTIONS = {
    "experience": ("experience", "work history", "employment", "career"),
    "education": ("education", "academic", "qualification", "university", "college"),
    "skills": ("skills", "technologies", "tools", "expertise", "competencies", "technical"),
}
SECTION_LENGTH = 60
DEGREES = ("bachelor", "master", "phd", "b.s", "m.s", "b.e", "m.e", "b.tech", "m.tech", "mba", "b.a", "m.a", "associate")
NOT_NAMES = ("experience", "education", "skills", "resume", "curriculum")
RESERVED_HANDLES = ("com", "orgs", "topics", "trending")
RESERVED_USERS = ("login", "signup", "explore")
PROFILE_HOSTS = ("github.com", "api.github.com")

PHONE_PATTERN = r"[+(]?[\d\s\-().]{7,20}\d"
EMAIL_PATTERN = r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}"
URL_PATTERN = r"(?i)https?://\S+|www\.\S+"
LINKEDIN_PATTERN = r"(?i)linkedin\.com/in/([\w\-]+)"
GITHUB_PATTERN = r"(?i)github\.com/([\w\-]+)"
MONTH_YEAR_PATTERN = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s*\d{4}|\d{4}"
RANGE_PATTERN = rf"({MONTH_YEAR_PATTERN})\s*[–\-—to]+\s*({MONTH_YEAR_PATTERN}|[Pp]resent|[Cc]urrent)"

# ---- End of the fixed values. ----
