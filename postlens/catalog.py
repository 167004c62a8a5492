"""Our own dictionaries: skills, role families, places. Small tables, read as DataFrames and broadcast by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: category, canonical name, terms, whether case matters
SKILLS = (
    ("language", "Python", ("python",), False), ("language", "Java", ("java",), False), ("language", "C++", ("c++",), False), ("language", "C#", ("c#",), False), ("language", "Go", ("Go", "golang"), True), ("language", "R", ("R",), True),
    ("language", "SQL", ("sql", "postgresql", "mysql"), False), ("data", "Spark", ("spark", "pyspark"), False), ("data", "Kafka", ("kafka",), False), ("data", "Airflow", ("airflow",), False), ("data", "Excel", ("Excel",), True),
    ("cloud", "AWS", ("aws", "amazon web services"), False), ("cloud", "Azure", ("azure",), False), ("cloud", "Kubernetes", ("kubernetes", "k8s"), False), ("cloud", "Docker", ("docker",), False),
    ("design", "AutoCAD", ("autocad",), False), ("design", "SolidWorks", ("solidworks",), False), ("health", "Patient care", ("patient care", "hasta bakımı"), False), ("finance", "Accounting", ("accounting", "muhasebe"), False),
    ("finance", "Tax", ("tax return", "vergi beyannamesi"), False), ("sales", "Negotiation", ("negotiation", "müzakere"), False), ("hr", "Recruitment", ("recruitment", "işe alım"), False),
    ("language", "JavaScript", ("javascript",), False), ("language", "TypeScript", ("typescript",), False), ("language", "Kotlin", ("kotlin",), False), ("language", "Swift", ("Swift",), True), ("language", "Rust", ("Rust",), True), ("language", "Scala", ("Scala",), True),
    ("language", "PHP", ("php",), False), ("language", "Ruby", ("Ruby",), True), ("language", "MATLAB", ("matlab",), False), ("language", "Perl", ("Perl",), True), ("language", "Bash", ("Bash", "shell scripting"), True), ("language", "VBA", ("vba",), False),
    ("web", "React", ("React", "react.js", "reactjs"), True), ("web", "Angular", ("angular",), False), ("web", "Vue", ("Vue", "vue.js"), True), ("web", "Node.js", ("node.js", "nodejs"), False), ("web", "Django", ("django",), False), ("web", "Spring", ("spring boot", "spring framework"), False),
    ("web", "GraphQL", ("graphql",), False), ("web", "REST", ("rest api", "restful"), False), ("web", "HTML", ("html", "html5"), False), ("web", "CSS", ("css", "sass"), False),
    ("data", "pandas", ("pandas",), False), ("data", "NumPy", ("numpy",), False), ("data", "dbt", ("dbt",), False), ("data", "Hadoop", ("hadoop", "hdfs"), False), ("data", "Flink", ("flink",), False), ("data", "Snowflake", ("Snowflake",), True), ("data", "BigQuery", ("bigquery",), False),
    ("data", "Tableau", ("Tableau",), True), ("data", "Power BI", ("power bi", "powerbi"), False), ("data", "Looker", ("Looker",), True), ("data", "ETL", ("etl", "elt"), False), ("data", "Data modelling", ("data modelling", "data modeling"), False), ("data", "Statistics", ("statistics", "istatistik"), False),
    ("data", "MongoDB", ("mongodb",), False), ("data", "Redis", ("redis",), False), ("data", "Elasticsearch", ("elasticsearch",), False), ("data", "Oracle", ("oracle database", "pl/sql"), False),
    ("learning", "Machine learning", ("machine learning", "makine öğrenmesi"), False), ("learning", "Deep learning", ("deep learning",), False), ("learning", "PyTorch", ("pytorch",), False), ("learning", "TensorFlow", ("tensorflow",), False), ("learning", "scikit-learn", ("scikit learn", "scikit-learn", "sklearn"), False),
    ("learning", "Computer vision", ("computer vision",), False), ("learning", "NLP", ("nlp", "natural language processing"), False), ("learning", "LLM", ("llm", "large language models"), False),
    ("cloud", "Google Cloud", ("gcp", "google cloud"), False), ("cloud", "Terraform", ("terraform",), False), ("cloud", "Ansible", ("ansible",), False), ("cloud", "Jenkins", ("jenkins",), False), ("cloud", "CI/CD", ("ci/cd", "ci cd", "continuous integration"), False), ("cloud", "Linux", ("linux",), False),
    ("cloud", "Prometheus", ("prometheus",), False), ("cloud", "Grafana", ("grafana",), False), ("cloud", "Helm", ("Helm",), True), ("cloud", "Git", ("Git", "github", "gitlab"), True),
    ("security", "Penetration testing", ("penetration testing", "pentest"), False), ("security", "SIEM", ("siem", "splunk"), False), ("security", "ISO 27001", ("iso 27001",), False), ("security", "Firewalls", ("firewall", "firewalls"), False),
    ("design", "Revit", ("revit",), False), ("design", "CATIA", ("catia",), False), ("design", "ANSYS", ("ansys",), False), ("design", "SketchUp", ("sketchup",), False), ("design", "3ds Max", ("3ds max",), False), ("design", "Photoshop", ("photoshop",), False), ("design", "Illustrator", ("Illustrator",), True), ("design", "Figma", ("figma",), False), ("design", "InDesign", ("indesign",), False),
    ("making", "CNC", ("cnc",), False), ("making", "PLC", ("plc", "ladder logic"), False), ("making", "Welding", ("mig welding", "tig welding", "gazaltı kaynak"), False), ("making", "Lean", ("lean manufacturing", "yalın üretim"), False), ("making", "Six Sigma", ("six sigma", "altı sigma"), False), ("making", "Quality control", ("quality control", "kalite kontrol"), False), ("making", "HVAC", ("hvac",), False),
    ("making", "SCADA", ("scada",), False), ("making", "PCB design", ("pcb design", "altium"), False), ("making", "Power electronics", ("power electronics", "güç elektroniği"), False), ("building", "Site management", ("site management", "şantiye yönetimi"), False), ("building", "Quantity surveying", ("quantity surveying", "metraj"), False), ("building", "Structural analysis", ("structural analysis", "sap2000", "etabs"), False),
    ("health", "First aid", ("first aid", "ilk yardım"), False), ("health", "Intensive care", ("intensive care", "yoğun bakım"), False), ("health", "Physiotherapy", ("physiotherapy", "fizyoterapi"), False), ("health", "Pharmacology", ("pharmacology", "farmakoloji"), False), ("health", "Clinical trials", ("clinical trials", "klinik araştırma"), False),
    ("finance", "IFRS", ("ifrs", "tfrs"), False), ("finance", "Auditing", ("auditing", "bağımsız denetim"), False), ("finance", "Payroll", ("payroll", "bordro"), False), ("finance", "Budgeting", ("budgeting", "bütçeleme"), False), ("finance", "Financial modelling", ("financial modelling", "financial modeling"), False), ("finance", "Risk management", ("risk management", "risk yönetimi"), False), ("finance", "SAP", ("SAP",), True), ("finance", "Logo", ("logo tiger", "logo netsis"), False),
    ("sales", "CRM", ("crm", "salesforce"), False), ("sales", "Cold calling", ("cold calling",), False), ("sales", "Account management", ("account management", "müşteri yönetimi"), False), ("sales", "E-commerce", ("e commerce", "e-commerce", "e ticaret", "e-ticaret"), False),
    ("marketing", "SEO", ("seo",), False), ("marketing", "Google Ads", ("google ads", "adwords"), False), ("marketing", "Google Analytics", ("google analytics",), False), ("marketing", "Copywriting", ("copywriting", "metin yazarlığı"), False), ("marketing", "Social media", ("social media", "sosyal medya"), False), ("marketing", "Market research", ("market research", "pazar araştırması"), False),
    ("hr", "Performance reviews", ("performance reviews", "performans değerlendirme"), False), ("hr", "Onboarding", ("onboarding", "oryantasyon"), False), ("hr", "Labour law", ("labour law", "labor law", "iş hukuku"), False),
    ("law", "Contract law", ("contract law", "sözleşme hukuku"), False), ("law", "GDPR", ("gdpr", "kvkk"), False), ("law", "Litigation", ("litigation", "dava takibi"), False), ("teaching", "Lesson planning", ("lesson planning", "ders planlama"), False), ("teaching", "Classroom management", ("classroom management", "sınıf yönetimi"), False),
    ("logistics", "Supply chain", ("supply chain", "tedarik zinciri"), False), ("logistics", "Customs", ("customs clearance", "gümrük"), False), ("logistics", "Warehousing", ("warehousing", "depo yönetimi"), False), ("logistics", "Forklift", ("forklift",), False), ("logistics", "Procurement", ("procurement", "satın alma"), False),
    ("service", "Call centre", ("call centre", "call center", "çağrı merkezi"), False), ("service", "Ticketing", ("zendesk", "ticketing"), False), ("service", "Food safety", ("food safety", "haccp", "gıda güvenliği"), False), ("service", "Barista", ("barista",), False),
    ("management", "Agile", ("agile", "scrum"), False), ("management", "Project management", ("project management", "proje yönetimi"), False), ("management", "Stakeholder management", ("stakeholder management",), False), ("management", "Roadmapping", ("product roadmap", "roadmapping"), False), ("management", "Jira", ("jira",), False),
    ("science", "Laboratory work", ("laboratory techniques", "laboratuvar teknikleri"), False), ("science", "HPLC", ("hplc",), False), ("science", "PCR", ("pcr",), False), ("science", "GMP", ("gmp",), False),
)

#: family, weight, title patterns, strong triggers, supporting triggers, least supporting ones, technical
FAMILIES = (
    ("data", 1.0, (r"\bdata (engineer|scientist|analyst)\b", r"\bveri (mühendisi|analisti)\b"), ("Spark", "Airflow"), ("SQL", "Python", "Kafka"), 2, True),
    ("software", 0.9, (r"\b(software|backend|frontend|full[- ]?stack) (engineer|developer)\b", r"\byazılım"), ("C++", "Java", "Go"), ("Python", "Docker", "SQL"), 2, True),
    ("cloud", 0.9, (r"\b(devops|sre|platform|cloud) ?(engineer)?\b",), ("Kubernetes", "AWS"), ("Docker", "Azure"), 2, True),
    ("mechanical", 0.8, (r"\bmechanical\b", r"\bmakine mühendisi\b"), ("SolidWorks",), ("AutoCAD", "Excel"), 2, False),
    ("finance", 0.8, (r"\b(accountant|accounting|finance)\b", r"\bmuhasebe"), ("Accounting", "Tax"), ("Excel",), 2, False),
    ("health", 0.8, (r"\b(nurse|hemşire)\b",), ("Patient care",), (), 2, False),
    ("people", 0.7, (r"\b(recruiter|talent acquisition|human resources)\b", r"\binsan kaynakları\b"), ("Recruitment",), ("Negotiation",), 3, False),
    ("sales", 0.7, (r"\b(sales|account executive)\b", r"\bsatış\b"), ("Negotiation",), ("Excel",), 3, False),
    ("learning", 1.0, (r"\b(machine learning|ml|ai) (engineer|scientist|researcher)\b", r"\byapay zeka\b"), ("Machine learning", "PyTorch", "TensorFlow"), ("scikit-learn", "NLP", "LLM"), 2, True),
    ("web", 0.9, (r"\b(web|front[- ]?end|ui) (developer|engineer)\b",), ("React", "Angular", "Vue"), ("JavaScript", "TypeScript", "CSS", "HTML"), 2, True),
    ("security", 0.9, (r"\b(security|infosec|soc) (engineer|analyst)\b", r"\bsiber güvenlik\b"), ("Penetration testing", "SIEM"), ("ISO 27001", "Firewalls"), 2, True),
    ("electrical", 0.8, (r"\b(electrical|electronics) engineer\b", r"\belektrik( elektronik)? mühendisi\b"), ("PLC", "PCB design", "Power electronics"), ("SCADA", "MATLAB"), 2, False),
    ("civil", 0.8, (r"\b(civil|structural|site) engineer\b", r"\binşaat mühendisi\b"), ("Site management", "Structural analysis"), ("Quantity surveying", "Revit"), 2, False),
    ("architecture", 0.8, (r"\b(interior )?architect\b(?! ?\()", r"\bmimar\b"), ("SketchUp", "3ds Max"), ("Revit", "Photoshop"), 2, False),
    ("industrial", 0.8, (r"\b(industrial|process|quality) engineer\b", r"\bendüstri mühendisi\b"), ("Lean", "Six Sigma"), ("Quality control", "SAP"), 2, False),
    ("graphic", 0.7, (r"\b(graphic|visual|ux|product) designer\b", r"\bgrafik tasarım"), ("Illustrator", "Figma"), ("Photoshop", "InDesign"), 2, False),
    ("marketing", 0.7, (r"\b(marketing|seo|content) (manager|specialist|executive)\b", r"\bpazarlama\b"), ("SEO", "Google Ads"), ("Google Analytics", "Copywriting", "Social media"), 2, False),
    ("law", 0.8, (r"\b(lawyer|attorney|legal counsel|paralegal)\b", r"\bavukat\b"), ("Litigation", "Contract law"), ("GDPR", "Labour law"), 2, False),
    ("teaching", 0.7, (r"\b(teacher|lecturer|tutor)\b", r"\böğretmen"), ("Lesson planning",), ("Classroom management",), 2, False),
    ("logistics", 0.7, (r"\b(logistics|supply chain|procurement)\b", r"\blojistik\b"), ("Supply chain", "Customs"), ("Warehousing", "Procurement"), 2, False),
    ("service", 0.6, (r"\b(customer (service|support|success))\b", r"\bmüşteri hizmetleri\b"), ("Call centre",), ("Ticketing", "CRM"), 3, False),
    ("hospitality", 0.6, (r"\b(chef|cook|waiter|barista)\b", r"\b(aşçı|garson)\b"), ("Food safety", "Barista"), (), 2, False),
    ("product", 0.9, (r"\b(product|project|program) (manager|owner)\b", r"\bproje yöneticisi\b"), ("Roadmapping", "Project management"), ("Agile", "Jira", "Stakeholder management"), 2, False),
    ("science", 0.8, (r"\b(chemist|biologist|laboratory technician)\b", r"\bkimyager\b"), ("HPLC", "PCR"), ("GMP", "Laboratory work"), 2, False),
)

#: tag, display name, region, aliases
COUNTRIES = (
    ("turkey", "Türkiye", "emea", ("turkey", "türkiye", "turkiye")), ("germany", "Germany", "emea", ("germany", "deutschland")), ("france", "France", "emea", ("france",)), ("spain", "Spain", "emea", ("spain", "españa")),
    ("uk", "United Kingdom", "emea", ("united kingdom", "uk", "england", "great britain")), ("netherlands", "Netherlands", "emea", ("netherlands", "holland")), ("israel", "Israel", "emea", ("israel",)), ("poland", "Poland", "emea", ("poland",)),
    ("usa", "United States", "amer", ("united states", "usa", "u.s.", "us")), ("canada", "Canada", "amer", ("canada",)), ("brazil", "Brazil", "amer", ("brazil", "brasil")), ("india", "India", "apac", ("india",)), ("japan", "Japan", "apac", ("japan",)), ("australia", "Australia", "apac", ("australia",)),
)
CITIES = {"bursa": "turkey", "antalya": "turkey", "hamburg": "germany", "frankfurt": "germany", "cologne": "germany", "lyon": "france", "toulouse": "france", "valencia": "spain", "manchester": "uk", "edinburgh": "uk", "rotterdam": "netherlands", "eindhoven": "netherlands", "haifa": "israel", "krakow": "poland", "wroclaw": "poland", "chicago": "usa", "seattle": "usa", "boston": "usa", "austin": "usa", "vancouver": "canada", "montreal": "canada", "rio de janeiro": "brazil", "mumbai": "india", "hyderabad": "india", "osaka": "japan", "melbourne": "australia", "istanbul": "turkey", "ankara": "turkey", "izmir": "turkey", "berlin": "germany", "munich": "germany", "paris": "france", "madrid": "spain", "barcelona": "spain", "london": "uk", "amsterdam": "netherlands", "tel aviv": "israel", "warsaw": "poland", "new york": "usa", "san francisco": "usa", "toronto": "canada", "são paulo": "brazil", "bangalore": "india", "tokyo": "japan", "sydney": "australia"}
US_STATES = ("california", "texas", "new york state", "washington", "florida", "ca", "tx", "ny", "wa", "fl", "ma", "il", "co")
REGIONS = {"emea": ("turkey", "germany", "france", "spain", "uk", "netherlands", "israel", "poland"), "europe": ("germany", "france", "spain", "uk", "netherlands", "poland"), "latam": ("brazil",), "north america": ("usa", "canada"), "apac": ("india", "japan", "australia")}
#: Companies by source, as a plan of requests.
COMPANIES = (("greenhouse", "acme", "Acme"), ("greenhouse", "globex", "Globex"), ("lever", "initech", "Initech"), ("ashby", "umbrella", "Umbrella"))


def skills(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, t, cs) for c, n, terms, cs in SKILLS for t in terms], "category string, canonical string, term string, case_sensitive boolean")


def families(spark: SparkSession) -> DataFrame:
    rows = [(i, *f) for i, f in enumerate(FAMILIES)]
    return spark.createDataFrame(rows, "ord int, family string, weight double, titles array<string>, strong array<string>, supporting array<string>, least int, technical boolean")


def places(spark: SparkSession) -> DataFrame:
    """token, tier, tag: tier 1 country, 2 state or region, 3 city."""
    rows = [(a, 1, tag) for tag, _, _, aliases in COUNTRIES for a in aliases] + [(s, 2, "usa") for s in US_STATES] + [(r, 2, t) for r, tags in REGIONS.items() for t in tags] + [(c, 3, t) for c, t in CITIES.items()]
    return spark.createDataFrame(rows, "token string, tier int, tag string")


def place_names() -> list[str]:
    """What may trail a title; ``us`` isn't among it, as titles end in that word for other reasons."""
    return [a for _, _, _, aliases in COUNTRIES for a in aliases if a != "us"] + [*CITIES, *REGIONS]
