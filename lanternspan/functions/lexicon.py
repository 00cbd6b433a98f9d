"""Word lists, lookup tables, patterns and limits that results depend on. Operators take them as parameters."""

# Fixed values.
ENTITY_LABELS = (
    'TECHNOLOGY', 'JOB_ROLE', 'SKILL', 'WORK_ACTIVITY', 'INDUSTRY', 'PROJECT_TYPE', 'DEGREE', 'CERTIFICATION',
)

# Fixed values.
ROLE_KEYWORDS = (
    'Business Analyst', 'BI Developer', 'Data Analyst', 'Data Engineer', 'Data Scientist', 'Data Architect', 'Solutions Architect',
    'Solution Architect', 'Product Manager', 'Project Manager', 'Scrum Master', 'Team Lead', 'Tech Lead', 'QA Automation Engineer', 'QA Engineer',
    'QA Automation', 'DevOps Engineer', 'Support Engineer', 'Support Analyst', 'Customer Support Specialist', 'Technical Writer', 'Sysadmin',
    'System Administrator', 'Security Engineer', 'Frontend Developer', 'Front-end Developer', 'Backend Developer', 'Back-end Developer',
    'Full Stack Developer', 'Fullstack Developer', 'Software Engineer', 'Android Developer', 'iOS Developer', 'Unity Developer', 'Java Developer',
    'Python Developer', 'PHP Developer', '.NET Developer', 'Node.js Developer', 'Golang Developer', 'Ruby Developer', 'Scala Developer',
    'C++ Developer',
)

# Fixed values.
ROLE_HINT_TOKENS = (
    'developer', 'engineer', 'analyst', 'manager', 'writer', 'architect', 'administrator', 'admin', 'scientist', 'designer', 'consultant',
    'specialist',
)

# Fixed values.
GENERIC_ROLE_TERMS = (
    'analyst', 'architect', 'developer', 'engineer', 'lead', 'manager', 'qa', 'support', 'writer',
)

# Fixed values.
TECHNOLOGY_TERMS = (
    '.NET', 'ASP.NET', 'Airflow', 'Android', 'Angular', 'Ansible', 'AWS', 'Azure', 'Bitbucket', 'C#', 'C++', 'CSS', 'Cypress', 'Django', 'Docker',
    'Elasticsearch', 'Express', 'FastAPI', 'Firebase', 'Flask', 'GCP', 'Git', 'GitHub', 'GitLab', 'Go', 'Golang', 'Grafana', 'GraphQL', 'Helm',
    'HTML', 'Java', 'JavaScript', 'Jenkins', 'Jira', 'Kafka', 'Kotlin', 'Kubernetes', 'Laravel', 'Linux', 'MongoDB', 'MySQL', 'Node.js', 'NoSQL',
    'NumPy', 'Pandas', 'PHP', 'Playwright', 'PostgreSQL', 'Postgres', 'Power BI', 'PowerBI', 'Prometheus', 'PyTorch', 'Python', 'React', 'Redis',
    'REST API', 'Ruby', 'Rust', 'Scala', 'scikit-learn', 'Selenium', 'Spark', 'Spring', 'Spring Boot', 'SQL', 'Swift', 'Tableau', 'Terraform',
    'TensorFlow', 'TypeScript', 'Unity', 'Unreal Engine', 'Vue',
)

# Fixed values.
SKILL_TERMS = (
    'analytical skills', 'communication', 'communication skills', 'critical thinking', 'mentoring', 'negotiation', 'presentation skills',
    'product management', 'project management', 'requirements analysis', 'stakeholder management', 'teamwork', 'time management', 'troubleshooting',
    'writing skills',
)

# Fixed values.
INDUSTRY_TERMS = (
    'adtech', 'automotive', 'banking', 'blockchain', 'crypto', 'cybersecurity', 'e-commerce', 'ecommerce', 'edtech', 'fintech', 'gaming',
    'healthcare', 'insurance', 'martech', 'telecom', 'web3',
)

# Fixed values.
PROJECT_TYPE_TERMS = (
    'api platform', 'blockchain project', 'cloud platform', 'computer vision', 'dashboard', 'data pipeline', 'data warehouse', 'etl pipeline',
    'machine learning model', 'microservices', 'mobile application', 'mobile app', 'recommender system', 'saas product', 'web application',
    'web app',
)

# Fixed values.
CERTIFICATION_SPANS = (
    r"\bAWS Certified(?: [A-Za-z][A-Za-z -]+)?\b",
    r"\bAzure (?:Administrator|Fundamentals|Solutions Architect|Developer)(?: Associate| Expert)?\b",
    r"\bGoogle Cloud (?:Professional|Associate) [A-Za-z -]+\b",
    r"\bISTQB\b",
    r"\bPMP\b",
    r"\bCertified Kubernetes Administrator\b",
    r"\bCKA\b",
    r"\bCCNA\b",
)

# Fixed values.
DEGREE_SPANS = (
    r"\bBachelor's(?: degree)?(?: in [A-Za-z][A-Za-z /&-]+| of [A-Za-z][A-Za-z /&-]+)?\b",
    r"\bBachelor degree(?: in [A-Za-z][A-Za-z /&-]+| of [A-Za-z][A-Za-z /&-]+)?\b",
    r"\bBachelor of [A-Za-z][A-Za-z /&-]+\b",
    r"\bBachelor in [A-Za-z][A-Za-z /&-]+\b",
    r"\bMaster's(?: degree)?(?: in [A-Za-z][A-Za-z /&-]+| of [A-Za-z][A-Za-z /&-]+)?\b",
    r"\bMaster degree(?: in [A-Za-z][A-Za-z /&-]+| of [A-Za-z][A-Za-z /&-]+)?\b",
    r"\bMaster of [A-Za-z][A-Za-z /&-]+\b",
    r"\bMaster in [A-Za-z][A-Za-z /&-]+\b",
    r"\bPh\.?D\.?(?: in [A-Za-z][A-Za-z /&-]+)?\b",
    r"\bB\.?Sc\.?(?: in [A-Za-z][A-Za-z /&-]+)?\b",
    r"\bM\.?Sc\.?(?: in [A-Za-z][A-Za-z /&-]+)?\b",
    r"\bMBA\b",
)

# Fixed values.
WORK_ACTIVITY_VERBS = (
    'analyze', 'automate', 'build', 'collaborate', 'conduct', 'coordinate', 'create', 'deliver', 'deploy', 'design', 'develop', 'document',
    'estimate', 'ghostwrote', 'help', 'implement', 'integrate', 'lead', 'maintain', 'manage', 'migrate', 'monitor', 'optimize', 'participate',
    'plan', 'produce', 'research', 'support', 'take part', 'test', 'troubleshoot', 'write',
)

# Fixed values.
FACT_TYPES = (
    'EXPERIENCE_YEARS', 'DEGREE', 'CERTIFICATION',
)

# Fixed values.
ENTITY_LABEL_ALIASES = {
    'TECHNOLOGIES': 'TECHNOLOGY',
    'TECH': 'TECHNOLOGY',
    'TOOLS': 'TECHNOLOGY',
    'TOOL': 'TECHNOLOGY',
    'JOB': 'JOB_ROLE',
    'JOBS': 'JOB_ROLE',
    'JOBS_ROLE': 'JOB_ROLE',
    'JOB_ROLES': 'JOB_ROLE',
    'ROLE': 'JOB_ROLE',
    'ROLES': 'JOB_ROLE',
    'SKILLS': 'SKILL',
    'WORK_ACTIVITIES': 'WORK_ACTIVITY',
    'TASK': 'WORK_ACTIVITY',
    'TASKS': 'WORK_ACTIVITY',
    'INDUSTRIES': 'INDUSTRY',
    'PROJECT_TYPES': 'PROJECT_TYPE',
    'PROJECT': 'PROJECT_TYPE',
    'PROJECTS': 'PROJECT_TYPE',
    'EDUCATION': 'DEGREE',
    'DEGREES': 'DEGREE',
    'CERTIFICATIONS': 'CERTIFICATION',
}

# Fixed values.
FACT_TYPE_ALIASES = {
    'EXPERIENCE': 'EXPERIENCE_YEARS',
    'YEARS_EXPERIENCE': 'EXPERIENCE_YEARS',
    'MIN_EXPERIENCE_YEARS': 'EXPERIENCE_YEARS',
    'DEGREES': 'DEGREE',
    'REQUIRED_DEGREE': 'DEGREE',
    'CERTIFICATIONS': 'CERTIFICATION',
    'REQUIRED_CERTIFICATION': 'CERTIFICATION',
}

# Fixed values.
TEXT_COLUMN_CANDIDATES = (
    'text', 'body', 'content', 'document', 'document_text', 'full_text', 'raw_text', 'cv', 'cv_text', 'resume', 'resume_text', 'profile',
    'profile_text', 'jd', 'jd_text', 'job_description', 'job_desc', 'description', 'vacancy_text', 'posting_text',
)

# Fixed values.
ID_COLUMN_CANDIDATES = (
    'id', '_id', 'uuid', 'doc_id', 'document_id', 'record_id', 'candidate_id', 'job_id',
)

# Fixed values.
DOC_TYPE_COLUMN_CANDIDATES = (
    'doc_type', 'document_type', 'type', 'source', 'kind', 'side', 'record_type',
)

# Fixed values.
LANGUAGE_COLUMN_CANDIDATES = (
    'language', 'lang',
)

# Fixed values.
ENGLISH_LEVEL_TERMS = (
    'basic', 'beginner', 'elementary', 'intermediate', 'upper', 'upper intermediate', 'upper-intermediate', 'pre', 'pre intermediate',
    'pre-intermediate', 'advanced', 'fluent', 'no english',
)

# Fixed values.
ENGLISH_LEVEL_CONTEXT_TERMS = (
    'conversational', 'proficient', 'proficiency',
)

# Fixed values.
NON_SKILL_TERMS = (
    'agile', 'design pattern', 'design patterns', 'clean architecture', 'hexagonal architecture', 'layered architecture',
    'microservice architecture', 'microservices architecture', 'mvp', 'mvvm', 'object oriented programming', 'object-oriented programming', 'oop',
    'oop principles', 'qa automation', 'solid', 'scrum',
)

# Fixed values.
NON_INDUSTRY_TERMS = (
    'it', 'information technology', 'security', 'cybersecurity', 'data science', 'software', 'software development', 'saas', 'analytics', 'ai',
    'engineering', 'product company', 'technology', 'game development', 'blockchain', 'computer vision', 'gamedev', 'networking',
)

# Fixed values.
GENERIC_PROJECT_TYPE_TERMS = (
    'application', 'applications', 'app', 'apps', 'project', 'projects', 'platform', 'platforms', 'product', 'products', 'mobile app', 'mobile apps',
    'mobile application', 'mobile applications', 'web app', 'web apps', 'web application', 'web applications', 'web development', 'backend project',
    'backend projects', 'client server application', 'client-server application', 'desktop ui application', 'desktop ui applications',
    'embedded project', 'embedded projects', 'finished project', 'finished projects', 'frontend project', 'frontend projects', 'pet project',
    'pet projects', 'published application', 'published applications', 'real project', 'real projects', 'web project', 'web projects',
)

# Fixed values.
GENERIC_WORK_ACTIVITY_TERMS = (
    'testing', 'code review', 'bug fixing', 'fixing bugs', 'manual testing', 'api testing', 'unit testing', 'software development',
    'application development', 'android development', 'performance testing', 'data visualization', 'test automation', 'refactoring',
    'backend development', 'frontend development', 'business analysis', 'database design', 'requirements analysis',
)

# Fixed values.
WORK_ACTIVITY_PREFIXES = (
    'to ', 'responsible for ', 'experience in ', 'experience with ', 'experienced in ', 'experienced with ', 'hands-on ', 'hands on ',
    'involved in ', 'focused on ',
)

# Fixed values.
NOISY_PREFIXES = (
    'strong ', 'good ', 'excellent ', 'solid ', 'deep ', 'basic ', 'experience in ', 'experience with ', 'experienced in ', 'experienced with ',
    'understanding of ', 'knowledge of ', 'familiarity with ', 'familiar with ', 'hands-on ', 'hands on ',
)

# Fixed values.
ACTION_VERB_TOKENS = (
    'analyze', 'analyzed', 'analyzing', 'architect', 'architected', 'architecting', 'automate', 'automated', 'automating', 'build', 'building',
    'built', 'collaborate', 'collaborated', 'collaborating', 'configure', 'configured', 'configuring', 'coordinate', 'coordinated', 'coordinating',
    'create', 'created', 'creating', 'debug', 'debugged', 'debugging', 'deploy', 'deployed', 'deploying', 'design', 'designed', 'designing',
    'develop', 'developed', 'developing', 'document', 'documented', 'documenting', 'estimate', 'estimated', 'estimating', 'execute', 'executed',
    'executing', 'implement', 'implemented', 'implementing', 'improve', 'improved', 'improving', 'integrate', 'integrated', 'integrating', 'lead',
    'leading', 'led', 'maintain', 'maintained', 'maintaining', 'manage', 'managed', 'managing', 'mentor', 'mentored', 'mentoring', 'migrate',
    'migrated', 'migrating', 'monitor', 'monitored', 'monitoring', 'optimize', 'optimized', 'optimizing', 'own', 'owned', 'owning', 'plan',
    'planned', 'planning', 'refactor', 'refactored', 'refactoring', 'review', 'reviewed', 'reviewing', 'support', 'supported', 'supporting', 'test',
    'tested', 'testing', 'troubleshoot', 'troubleshooting', 'troubleshot', 'write', 'writing', 'wrote', 'written',
)

# Fixed values.
DEGREE_KEYWORD_PATTERNS = (
    r"\bbachelor(?:'s)?\b",
    r"\bmaster(?:'s)?\b",
    r"\bph\.?d\b",
    r"\bdoctorate\b",
    r"\bdegree\b",
    r"\bdiploma\b",
    r"\bb\.?\s?sc\b",
    r"\bm\.?\s?sc\b",
    r"\bmba\b",
)

# Fixed values.
DEGREE_NOISE_PATTERNS = (
    r"\bbachelor thesis\b",
    r"\bmaster thesis\b",
    r"\bph\.?d student\b",
    r"\bcomputer science background\b",
    r"\bsoftware engineering background\b",
)

# Fixed values.
CERTIFICATION_GENERIC_TERMS = (
    'aws', 'certificate', 'certification', 'certifications', 'microsoft certifications',
)

# Fixed values.
CERTIFICATION_NOISE_PATTERNS = (
    r"\bcourse\b",
    r"\bschool\b",
    r"\btraining\b",
    r"\btraining program\b",
    r"\bsubject\b",
    r"\bhatchery\b",
    r"\bdiploma projects?\b",
)

# Fixed values.
CERTIFICATION_PATTERNS = (
    r"\baws\b.*\b(certified|associate|professional|specialty)\b",
    r"\bazure\b.*\b(administrator|fundamentals|solutions architect|developer|associate|expert)\b",
    r"\bgoogle cloud\b.*\b(professional|associate)\b",
    r"\boracle certified\b",
    r"\bsitecore certified\b",
    r"\bcertified kubernetes\b",
    r"\bistqb\b",
    r"\bitil\b",
    r"\bpmp\b",
    r"\bccna\b",
    r"\brhcsa\b",
    r"\brhce\b",
    r"\bcka\b",
    r"\bckad\b",
)

# Fixed values.
SOURCE_LABEL_ALIASES = {
    'SKILL': 'SKILL',
    'SKILLS': 'SKILL',
    'HARD_SKILL': 'SKILL',
    'SOFT_SKILL': 'SKILL',
    'OCCUPATION': 'JOB_ROLE',
    'ROLE': 'JOB_ROLE',
    'JOB_ROLE': 'JOB_ROLE',
    'QUALIFICATION': 'DEGREE',
    'EDUCATION': 'DEGREE',
    'DEGREE': 'DEGREE',
    'CERTIFICATION': 'CERTIFICATION',
    'DOMAIN': 'INDUSTRY',
    'EXPERIENCE': 'WORK_ACTIVITY',
    'RESPONSIBILITY': 'WORK_ACTIVITY',
}

# Fixed values.
FILE_ALIASES = {
    'occupation_data': ('occupation data', 'occupation_data', 'occupationdata'),
    'alternate_titles': ('alternate titles', 'alternate_titles', 'alternatetitles'),
    'skills': ('skills',),
    'knowledge': ('knowledge',),
    'abilities': ('abilities',),
    'work_activities': ('work activities', 'work_activities', 'workactivities'),
    'technology_skills': ('technology skills', 'technology_skills', 'technologyskills'),
    'task_statements': ('task statements', 'task_statements', 'taskstatements'),
}

# Fixed values.
STOPWORDS = (
    'a', 'an', 'and', 'for', 'in', 'of', 'on', 'or', 'the', 'to', 'with',
)

# Fixed values.
SHORT_KEEP_TOKENS = (
    'ai', 'bi', 'c', 'c#', 'c++', 'go', 'js', 'ml', 'qa', 'ui', 'ux',
)

# Fixed values.
LABEL_TARGET_TYPES = {
    'JOB_ROLE': ('occupation', 'alternate_title'),
    'SKILL': ('skill', 'knowledge', 'ability'),
    'WORK_ACTIVITY': ('work_activity', 'task_statement'),
    'TECHNOLOGY': ('technology_skill', 'skill', 'knowledge'),
    'PROJECT_TYPE': ('task_statement', 'work_activity', 'technology_skill'),
}

# Fixed values.
MANUAL_TEXT_REPLACEMENTS = {
    '\xa0': ' ',
    '\u200b': '',
    '\ufeff': '',
    '\xe2\u20ac\u2122': "'",
    '\xe2\u20ac\u02dc': "'",
    '\xe2\u20ac\u0153': '"',
    '\xe2\u20ac\x9d': '"',
    '\xe2\u20ac\u201c': '-',
    '\xe2\u20ac\u201d': '-',
    '\xe2\u20ac\xa6': '...',
    '\xe2\u20ac\xa2': '-',
    '\u2022': '-',
    '\xc2 ': ' ',
    '\xc2': '',
    '\u0110\xa1#': 'C#',
}

# Fixed values.
CV_BUCKETS = (
    (400, 'short'), (900, 'medium'), (1800, 'long'),
)

# Fixed values.
JD_BUCKETS = (
    (1000, 'short'), (1800, 'medium'), (3000, 'long'),
)

# Fixed values.
IT_PRIMARY_KEYWORDS = (
    'Android', 'QA Automation', 'JavaScript', 'Node.js', 'PHP', 'Python', '.NET', 'Unity', 'Java', 'Data Analyst', 'Data Engineer', 'Data Science',
    'Golang', 'SQL', 'DevOps', 'QA', 'Security', 'Ruby', 'Sysadmin', 'C++', 'Scala', 'Rust', 'Flutter', 'iOS', 'Salesforce',
)

# Fixed values.
AMBIGUOUS_PRIMARY_KEYWORDS = (
    'Other', 'Lead', 'Project Manager', 'Support', 'Business Analyst', 'Product Manager', 'Scrum Master', 'Technical Writing',
)

# Fixed values.
IT_SIGNAL_TERMS = (
    'developer', 'engineer', 'devops', 'data scientist', 'data engineer', 'data analyst', 'qa', 'automation', 'tester', 'test engineer', 'backend',
    'back-end', 'frontend', 'front-end', 'fullstack', 'full stack', 'android', 'ios', 'mobile app', 'java', 'javascript', 'typescript', 'python',
    '.net', 'c#', 'c++', 'php', 'node', 'react', 'angular', 'golang', 'go developer', 'ruby', 'scala', 'rust', 'flutter', 'sql', 'database', 'aws',
    'azure', 'gcp', 'cloud', 'docker', 'kubernetes', 'linux', 'sysadmin', 'system administrator', 'network engineer', 'security', 'cybersecurity',
    'machine learning', 'artificial intelligence', 'blockchain', 'web3', 'unity', 'unreal', 'software', 'technical writer', 'salesforce',
)

# Fixed values.
STRICT_IT_ROLE_TERMS = (
    'software engineer', 'software developer', 'backend developer', 'backend engineer', 'frontend developer', 'frontend engineer',
    'front-end developer', 'front-end engineer', 'fullstack developer', 'fullstack engineer', 'full stack developer', 'full stack engineer',
    'android developer', 'android engineer', 'ios developer', 'ios engineer', 'mobile developer', 'mobile engineer', 'devops engineer',
    'platform engineer', 'site reliability engineer', 'sre', 'qa engineer', 'qa automation', 'test automation engineer', 'automation engineer',
    'data engineer', 'data scientist', 'data analyst', 'machine learning engineer', 'ml engineer', 'ai engineer', 'security engineer',
    'cybersecurity engineer', 'cloud engineer', 'system administrator', 'sysadmin', 'database administrator', 'dba', 'network engineer',
    'embedded engineer', 'unity developer', 'game developer', 'abap developer', 'sap developer', 'salesforce developer', '1c developer', 'developer',
    'engineer',
)

# Fixed values.
STRICT_IT_TECH_TERMS = (
    'python', 'java', 'javascript', 'typescript', 'node.js', 'node ', 'react', 'angular', 'vue', '.net', 'c#', 'c++', 'php', 'golang', 'go ', 'ruby',
    'scala', 'rust', 'sql', 'postgres', 'postgresql', 'mysql', 'mongodb', 'redis', 'aws', 'azure', 'gcp', 'docker', 'kubernetes', 'linux', 'airflow',
    'spark', 'etl', 'api', 'microservice', 'backend', 'frontend', 'android', 'ios', 'flutter', 'unity', 'unreal', 'machine learning',
    'deep learning', 'computer vision', 'nlp', 'blockchain', 'web3', 'salesforce', 'sap', 'abap', '1c', 'database', 'kafka', 'terraform', 'ci/cd',
)

# Fixed values.
STRICT_NON_IT_HEADER_TERMS = (
    'business analyst', 'product manager', 'project manager', 'scrum master', 'support', 'technical writer', 'technical writing', 'copywriter',
    'marketing', 'sales', 'recruiter', 'human resources', 'hr ', 'artist', 'designer', 'accountant', 'finance', 'financial', 'lawyer', 'legal',
    'teacher', 'translator', 'account manager', 'customer service', 'seo', 'content',
)

# Methods and architectures that are no skills.
NON_SKILL_PATTERNS = (
    r"\bqa automation\b",
    r"\bagile\b",
    r"\bscrum\b",
    r"\bdesign patterns?\b",
    r"\boop\b",
    r"\bobject[- ]oriented programming\b",
    r"\bmvvm\b",
    r"\bmvp\b",
    r"\bsolid\b",
    r"\bclean architecture\b",
    r"\bhexagonal architecture\b",
    r"\blayered architecture\b",
    r"\bmicroservices? architecture\b",
)

# Roles too general to be a span of their own.
GENERIC_JOB_ROLES = ("lead", "support", "qa", "analyst", "architect", "manager", "developer", "engineer", "writer")

# Words in document type names, the first list that matches decides.
DOC_TYPE_WORDS = {"cv": ("cv", "resume", "candidate", "profile"), "jd": ("jd", "job", "description", "vacancy", "posting", "role")}

# Limits of a request shard: bytes, requests, estimated tokens.
SHARD_LIMITS = (150 * 1024 * 1024, 25_000, 1_500_000)
