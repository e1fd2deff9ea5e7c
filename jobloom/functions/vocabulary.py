"""Words and patterns that decide how texts are read. All apply to text in lower case without accents."""

from __future__ import annotations

# Technologies in order of precedence, specific ones before their ecosystem: pattern, skill, subskill, skill of a profile.
TECHNOLOGIES: list[tuple[str, str, str | None, str | None]] = [
    (r"\bspring\s*boot\b", "Java", "Spring Boot", "spring"),
    (r"\bspring\s*(?:data|mvc|security|test)\b", "Java", "Spring", "spring"),
    (r"\bhibernate\b|\bjpa\b", "Java", "Hibernate/JPA", "spring"),
    (r"\bjakarta\s*ee\b|\bjava\s*ee\b|\bj2ee\b", "Java", "Jakarta EE", None),
    (r"java server faces|\bjsf\b", "Java", "JavaServer Faces", None),
    (r"\bjboss\b|\bapache\b", "Java", "Servidor de aplicação", None),
    (r"\bjunit\b|\bmockito\b", "Testes", "JUnit/Mockito", "tests"),
    (r"\bpytest\b", "Testes", "pytest", "tests"),
    (r"\bjmeter\b", "Testes", "JMeter", "tests"),
    (r"phpunit|\bpest\b", "Testes", "PHPUnit/Pest", "tests"),
    (r"\bselenium\b", "Automação", "Selenium", "auto"),
    (r"\bpl\s*/?\s*sql\b", "SQL", "PL/SQL", "sql"),
    (r"\bpostgres(?:ql)?\b", "SQL", "PostgreSQL", "sql"),
    (r"\bmysql\b", "SQL", "MySQL", "sql"),
    (r"\boracle\b", "SQL", "Oracle", "sql"),
    (r"\bmongodb\b", "Banco de dados", "MongoDB", None),
    (r"\bredis\b", "Banco de dados", "Redis", None),
    (r"\bamazon s3\b|\baws s3\b|\bs3\b", "AWS", "Amazon S3", "aws"),
    (r"\baws lambda\b|\blambda\b", "AWS", "AWS Lambda", "aws"),
    (r"\baws sqs\b|\bsqs\b", "AWS", "Amazon SQS", "aws"),
    (r"\baws sns\b|\bsns\b", "AWS", "Amazon SNS", "aws"),
    (r"\bcloudwatch\b", "AWS", "CloudWatch", "aws"),
    (r"\baws\b|amazon web services", "AWS", None, "aws"),
    (r"\bazure\b", "Azure", None, "azure"),
    (r"\bgcp\b|google cloud", "GCP", None, "gcp"),
    (r"\bdocker\b|\bpodman\b", "Contêineres", "Docker/Podman", "docker"),
    (r"\bkubernetes\b|\beks\b", "Contêineres", "Kubernetes", "k8s"),
    (r"\bterraform\b|cloudformation|infrastructure as code|\biac\b", "Infraestrutura como código", "Terraform/IaC", "iac"),
    (r"\bkafka\b|rabbitmq|mensageria|\bsqs\b|\bsns\b", "Mensageria", None, "msg"),
    (r"observabilidade|\bgrafana\b|\bsplunk\b|dynatrace|new relic|datadog|\bkibana\b", "Observabilidade", None, "obs"),
    (r"\bci\s*/\s*cd\b|\bci\b|github actions|gitlab ci|\bjenkins\b|devsecops", "CI/CD", None, "cicd"),
    (r"microsservic|microservice", "Microsserviços", None, "micro"),
    (r"\brest(?:ful)?\b|\bapis?\b|\bsoap\b|\bopenapi\b|\bswagger\b", "APIs", "REST/Integração", "api"),
    (r"\bgit\b|\bgithub\b|\bgitlab\b", "Controle de versão", "Git", "git"),
    (r"testes?|testing|\btdd\b|test automation|homologacao", "Testes", None, "tests"),
    (r"orientacao a objetos|design patterns?|\bsolid\b|clean code|code review|qualidade de codigo|\bdry\b|logica de programacao|estruturas de dados", "Design de software", "POO/Design", "design"),
    (r"\blinux\b|shell script|\bbash\b", "Linux", None, "linux"),
    (r"seguranca|security|\bowasp\b|\biam\b|\boauth\b|\bjwt\b|ping identity|\blgpd\b|\bgdpr\b", "Segurança", None, "sec"),
    (r"\bexcel\b", "Dados/BI", "Excel", "data"),
    (r"\bpower\s*bi\b", "Dados/BI", "Power BI", "data"),
    (r"\btableau\b", "Dados/BI", "Tableau", "data"),
    (r"\bdatabricks\b", "Dados/BI", "Databricks", "data"),
    (r"\bspark\b|\bpyspark\b", "Dados/BI", "Spark", "data"),
    (r"machine learning|inteligencia artificial|ia generativa|generative ai|\bia\b|\bllms?\b|prompt engineering|vertex ai|chatbots?|assistentes virtuais", "IA/ML", None, "ai"),
    (r"automacao|automation|\brpa\b|\buipath\b|\bn8n\b|\bbotcity\b", "Automação", None, "auto"),
    (r"troubleshooting|debugging|incidente|sustentacao|producao|\bdeploy\b|\brollback\b|\bgmud\b|suporte (?:a sistemas|tecnico)|\bitil\b", "Produção", "Troubleshooting", "prod"),
    (r"monitoramento|metricas e dashboards", "Observabilidade", None, "obs"),
    (r"modelagem de dados|manipulacao de dados|analise de dados|visualizacao de dados|estatistica|data warehouse|data lake|lakehouse|governanca de dados|qualidade de dados|analise (?:descritiva|preditiva|quantitativa)|indicadores|\bkpis?\b", "Dados/BI", None, "data"),
    (r"bancos? relacionais|banco de dados|\bnosql\b|administracao de banco de dados|backup/restore|replicacao", "Banco de dados", None, "sql"),
    (r"integracoes? entre sistemas|fluxos e jornadas digitais", "APIs", "Integração", "api"),
    (r"\bhtml5?\b|\bcss3?\b|webpack|\bvite\b", "Web", "Frontend", None),
    (r"metodologias ageis|\bscrum\b|\bkanban\b", "Métodos ágeis", None, None),
    (r"\bpython\b", "Python", None, "python"),
    (r"\bjava\b", "Java", None, "java"),
    (r"\.net\b|\bc#\b|asp\.net", ".NET", "C#/.NET", "dotnet"),
    (r"\bnode(?:\.js|js)?\b", "JavaScript", "Node.js", "js"),
    (r"\btypescript\b", "JavaScript", "TypeScript", "js"),
    (r"\bjavascript\b", "JavaScript", None, "js"),
    (r"\breact(?:\.js)?\b", "JavaScript", "React", None),
    (r"\bangular\b", "JavaScript", "Angular", None),
    (r"\bvue(?:\.js)?\b", "JavaScript", "Vue.js", None),
    (r"\bgo(?:lang)?\b", "Go", None, None),
    (r"\bcobol\b", "COBOL", None, None),
    (r"\bphp\b", "PHP", None, None),
    (r"\blaravel\b", "PHP", "Laravel", None),
    (r"\bsalesforce\b", "Salesforce", None, None),
    (r"\bsql\b", "SQL", None, "sql"),
    (r"\bcloud\b|\bnuvem\b", "Cloud", None, "cloud"),
]

# Words for a level of skill, looked for from high to low, and the labels of levels.
LEVELS = {
    4: r"especialista|expert|expertise profunda|arquitetura avancada",
    3: r"avancad|advanced|dominio|dominar|solido|proficien",
    2: r"intermedi",
    1: r"basic|basico|fundament|nocao|nocoes|introdutor|familiaridade",
}
LEVEL_LABELS = {1: "básico", 2: "intermediário", 3: "avançado", 4: "especialista"}

# What a requirement is about, by category.
ELIGIBILITY = r"\bpcd\b|pessoa(?:s)? com deficiencia|vaga afirmativa|elegibilidade"
EDUCATION = r"\b(?:formacao|graduacao|ensino superior|bacharel(?:ado)?|cursando|curso superior|degrees?)\b"
LOCATION = r"residir|residencia|localizacao|disponibilidade para (?:atuar|trabalhar|mudanca)|\bpresencial\b"
LANGUAGE = r"\bingles\b|\benglish\b|\bespanhol\b|\bspanish\b|\bportugues\b|\bportuguese\b"
TECHNICAL = r"backend|desenvolvimento de software|infraestrutura|redes|servidores|documentacao tecnica|regras de negocio|finops"
BEHAVIORAL = r"comunicacao|colabora|proativ|organizacao|autonomia|curiosidade|relacionamento|trabalho em equipe|senso de"
DOMAIN = r"mercado financeiro|meios de pagamento|fintech|bancari|credito|risco|fraude|investimento|renda fixa|compliance|\bfidc\b|ambiente sicoob"
TRANSFERABLE = ["sql", "api", "git", "tests", "design", "docker", "cicd", "micro", "msg", "obs", "linux", "iac", "sec", "data", "auto", "prod", "cloud"]
CATEGORIES = ["technical", "experience", "education", "language", "location", "modality", "eligibility", "behavioral", "domain", "other"]
TYPES = ["mandatory", "differential", "eliminatory"]
RELATIONS = ["single", "any", "all"]

# Headings of the sections of an advert (the whole heading, without what stands before its first letter).
REQUIREMENTS_HEADING = (
    r"^(?:pre[- ]requisitos(?: para candidatura| essenciais)?|requisitos(?: e qualificacoes| imprescindiveis| obrigatorios)?|qualificacoes|qualifications|requirements|minimum qualifications|"
    r"basic qualifications|required qualifications|what you need|who you are|o que (?:buscamos(?: em voce)?|voce precisa)|"
    r"o que procuramos|o perfil que estamos buscando e pre[- ]requisitos|"
    r"no que voce precisa mandar bem\??|(?:o que )?esperamos de voce|conhecimentos necessarios|perfil desejado|"
    r"precisamos que)\s*:?$"
)
DUTIES_HEADING = (
    r"^(?:as suas principais responsabilidades serao|(?:principais |suas |nossas )?(?:responsabilidades(?: e atribuicoes)?|atribuicoes)|"
    r"desafios e impacto|sobre a area de .+|principais atividades|atividades(?: da funcao)?|no seu dia a dia|o que voce (?:vai fazer|fara)(?: \(responsabilidades\))?|"
    r"responsibilities|what you (?:will|would) do|o que buscamos e principais responsabilidades)\s*:?$"
)
DIFFERENTIALS_HEADING = (
    r"^(?:diferencia(?:l|is)|o que aumenta as suas chances|requisitos desejaveis|nice[ -]to[ -]have|preferred qualifications|sera um plus|desejaveis?)\s*:?$"
)
STOP_HEADING = (
    r"^(?:beneficios|benefits|what we offer|offerings|responsabilidades|atribuicoes|responsibilities|"
    r"o que (?:voce vai fazer|fara)|oferecemos|sobre (?:nos|a empresa|o time)|about (?:us|the company|the team|the job)|"
    r"processo seletivo|etapas(?: do processo(?: seletivo)?)?|nossa cultura|informacoes adicionais|"
    r"employment type|type of employment|job type|tipo de emprego)\s*:?$"
)
# Words in a short line that end a section, beginnings that end one, and beginnings of a qualification.
STOP_WORDS = (
    r"beneficios|responsabilidades|atribuicoes|oferecemos|o que oferecemos|sobre (?:nos|a empresa|o time)|"
    r"processo seletivo|etapas do processo|etapas|como funciona|por que trabalhar|porque trabalhar|"
    r"nossa cultura|cultura e valores|ambiente de trabalho|informacoes adicionais|informacoes da vaga|"
    r"responsibilities|what (?:you will do|we offer)|about (?:us|the company|the team|the job)|"
    r"employment type|type of employment|job type|tipo de emprego"
)
STOP_BEGINNINGS = (
    r"^(?:ao se tornar (?:um |uma )?ituber\b|(?:nossos? |suas? )?(?:beneficios|vantagens)\b|"
    r"conheca mais sobre nossa cultura\b|se identificou com\b|inscreva-se e venha\b|assista o video\b|"
    r"para saber mais sobre nossas\b|saiba mais sobre nosso dia a dia\b|nosso pacote de remuneracao e beneficios\b|"
    r"jornada de trabalho\b|modelo/local de trabalho\b|modalidade\b|o que (?:oferecemos|voce ganha|voce encontrara)\b)"
)
QUALIFICATION = (
    r"^(?:conhecimentos?\b|experiencia\b|vivencia\b|familiaridade\b|dominio\b|formacao\b|"
    r"graduacao\b|ensino\b|superior\b|capacidade de\b|habilidade de\b|residir\b|"
    r"(?:ter|possuir) (?:conhecimento|experiencia|vivencia|formacao|graduacao)\b|"
    r"knowledge\b|experience\b|proficiency\b|familiarity\b|bachelor|master|degree\b)"
)
# Lines that are no requirement, technical titles and hard skills.
NOISE = (
    r"^\s*#li[- ](?:hybrid|remote|onsite)\b|"
    r"\bincentivo (?:a|aos) estudos\b|\bacesso aos clubes de lazer\b|\balgumas vantagens\b|"
    r"\bconheca mais sobre nossa cultura\b|\bao se tornar (?:um |uma )?ituber\b|"
    r"^\s*[#*+]?\s*(?:estimulamos candidaturas|somos comprometidos com a inclusao|vemproitau|vemserituber)\b|"
    r"\bvale[- ]?(?:transporte|refeicao|alimentacao)\b|\bplano (?:medico|de saude|odontologico)\b|"
    r"\bseguro de vida\b|\bprevidencia privada\b|\bplr\b|\blicenca (?:maternidade|paternidade)\b|"
    r"\bdescontos? exclusivos?\b|\bgympass\b|\bwellhub\b|\btotalpass\b|"
    r"\bteste cognitivo\b|\bvideo entrevista\b|\bentrevista com\b|\bentrevista focada\b|"
    r"\bviva bem\b|\buniversidade corporativa\b|\bparcerias? educacionais\b|\bparticipacao nos lucros\b|"
    r"\bcondicoes especiais em produtos\b|\bisencao de tarifas\b|\b\d+\s*[ªa]?\s*cesta alimentacao\b|\bauxilio creche\b|"
    r"\bprocesso seletivo\b|\brecrutamento\b|\bavaliacao tecnica\b|\betapas? do processo\b|"
    r"\bambiente dinamico\b|\bliberdade para trilhar\b|\bespaco para desenvolvimento\b|\bnivel de experiencia\b"
)
TECHNICAL_TITLE = (
    r"software|backend|back-end|developer|desenvolvedor|engenharia|dados|data|cloud|sre|devops|"
    r"automacao|python|java|\.net|c#|sistemas|infraestrutura|security|seguranca|qa|qualidade|quant"
)
HARD_SKILL = (
    r"\bpython\b|\bsql\b|\bjava\b|\.net|\bc#\b|javascript|typescript|node|react|angular|"
    r"\bapi\b|\bapis\b|\brest\b|\bgit\b|github|gitlab|aws|azure|gcp|cloud|docker|kubernetes|"
    r"kafka|rabbitmq|spring|banco de dados|database|tableau|power bi|metabase|spark|databricks|"
    r"machine learning|ia generativa|inteligencia artificial|linux|terraform|ci/cd|devops|"
    r"microsservic|microservice|observabilidade|security|seguranca|oracle|postgres|mysql|trino|starburst"
)

# Tags of an advert by what its text (lower case, accents kept) holds, in order.
TAGS = {
    "Python": r"\bpython\b|\bpyspark\b",
    "SQL": r"\bsql\b|\bplsql\b|\bpl/sql\b|\bpostgresql\b|\bmysql\b|\bsql server\b|\boracle\b",
    "Java": r"\bjava\b|spring boot|java ee|\bjunit\b",
    ".NET/C#": r"\.net|\bc#\b|asp\.net",
    "JavaScript/Node": r"javascript|node\.js|typescript|angular|react",
    "REST/APIs": r"\bapi\b|\bapis\b|\brest\b|soap|openapi|swagger|webhook",
    "Git": r"\bgit\b|github|gitlab",
    "Testes": r"teste|testes|unitário|unitario|tdd|pytest|junit|xunit|phpunit",
    "AWS": r"\baws\b|amazon web services|\bs3\b|lambda|\bsqs\b|\bsns\b|\brds\b|cloudwatch",
    "Azure": r"\bazure\b",
    "GCP": r"\bgcp\b|google cloud|bigquery|vertex ai",
    "Docker": r"docker|podman",
    "Kubernetes": r"kubernetes|\beks\b",
    "CI/CD": r"ci/cd|continuous integration|continuous delivery|jenkins|github actions|azure devops",
    "Microsserviços": r"microsservi|microservice",
    "Mensageria": r"mensageria|rabbitmq|kafka|\bsqs\b|\bsns\b|\bjms\b|fila|eventos",
    "Observabilidade": r"observabilidade|grafana|splunk|dynatrace|new relic|datadog|cloudwatch|kibana|tracing|métricas|metricas",
    "Cloud": r"\bcloud\b|nuvem|\baws\b|\bazure\b|\bgcp\b|\boci\b",
    "Linux": r"\blinux\b|shell script|\bbash\b",
    "Terraform/IaC": r"terraform|infrastructure as code|iac|cloudformation",
    "Dados/BI": r"dados|\bdata\b|power bi|tableau|databricks|spark|pyspark|data lake|redshift|bigquery|etl|elt",
    "Automação": r"automação|automacao|\brpa\b|uipath|n8n|botcity|selenium|scripts?",
    "IA/ML": r"inteligência artificial|inteligencia artificial|\bia\b|machine learning|llm|generative ai|ia generativa|scikit-learn|nlp",
    "Segurança": r"segurança|seguranca|security|owasp|iam|lgpd|oauth|jwt",
    "Crédito/Risco": r"crédito|credito|risco|fraude|pld|fidc|cobrança|cobranca",
    "POO/Design": r"orientação a objetos|orientacao a objetos|design patterns|\bsolid\b|clean code|ddd",
    "Troubleshooting/Produção": r"troubleshooting|incidente|produção|producao|deploy|rollback|sustentação|sustentacao|alta disponibilidade|missão crítica|missao critica",
}
# The area an advert belongs to by words in it, the first that fits.
AREAS = [
    ("Backend", ["backend", "back-end"]),
    ("Segurança", ["segurança", "seguranca", "security", "cyber", "fraude", "fraud"]),
    ("Dados & Analytics", ["dados", "data scientist", "cientista de dados", "analytics", "data engineer"]),
    ("Cloud / SRE", ["sre", "cloud", "infraestrutura", "devops"]),
    ("Automação & IA", ["automação", "automacao", "rpa"]),
    ("QA", ["qualidade", " qa", "testador"]),
    ("Governança & BI", ["governança", "governanca", "governance", "power bi", "power platform"]),
    ("Produtos Financeiros", ["pagamento", "payments", "open finance", "crédito", "credito", "risco"]),
    ("Sistemas / Sustentação", ["sistemas", "sustentação", "sustentacao"]),
]
OTHER_AREA = "Engenharia de Software"
# Stacks by a tag and words of the title, then by the tag alone.
STACKS = [("Python", "Python", ["python"]), ("Java", "Java", ["java", "spring"]), (".NET / C#", ".NET/C#", [".net", "c#"]), ("JavaScript / Node", "JavaScript/Node", ["node", "javascript", "typescript"])]
TAG_STACKS = [("Python", "Python"), ("Java", "Java"), (".NET / C#", ".NET/C#"), ("Dados / BI", "Dados/BI"), ("Cloud / SRE", "Cloud")]
OTHER_STACK = "Multistack"
