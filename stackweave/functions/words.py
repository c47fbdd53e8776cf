"""Word lists of the rules, by their ends; every function takes others in their place."""

GENERIC_BASES = tuple("""
    schema runtime core api ui sdk tool mcp provider worker browser server tools providers workers
    servers agents clients chat agent client
""".split())
GENERIC_FAMILIES = tuple("""
    web github atomic pydantic async embedded fixed tailwind playground space vscode node serde
    free language google azure vite reactive tsconfig lang match cli fastapi global universal model
    open plugin python minimap rollup logger prettier sass tailwindcss requests react microsoft
    default eslint typescript jest vitest rust i18next dev preview linux opentelemetry entity
""".split())
GENERIC_SCOPES = tuple("""
    @img/ @babel/ @rollup/ @types/
""".split())
AI_TOKENS = tuple("""
    cuda stagehand huggingface logfire rag torch ai openai llm vllm mcp browser tokenizer vector
    tokenizers qdrant sandbox
""".split())
AI_STEMS = tuple("""
    ollama anthropic embed guard inference serve lang eval model transform token diffus chat
    dataset agent copilot prompt
""".split())
NOISY_STEMS = tuple("""
    react- eslint- @esbuild/ @radix-ui/ @types/
""".split())
NOISY_NAMES = tuple("""
    react-dom react eslint
""".split())
COMMODITY = tuple("""
    @cubejs-backend/ @vscode/ @img/ @tanstack/ @aws-sdk/ @storybook/ @internal/ @babel/ @parcel/
    @rollup/ @angular/ @codemirror/ @types/ @vitest/ @nx/ @opentelemetry/ @sentry/ github pydantic
    pyobjc async tailwind serde tree google azure fastapi tauri remark python tokio http rollup
    tailwindcss requests aws windows react eslint typescript jest vitest pytest opentelemetry
""".split())
