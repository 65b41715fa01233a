"""Small repositories as rows, for the core tests."""

SMALL_APP = {
    "README.md": "# Small App\n\nA tiny fixture project.\n",
    "package.json": '{\n  "name": "small-app",\n  "scripts": { "build": "tsc", "test": "vitest run" },\n  "dependencies": { "express": "^4.19.2" },\n  "devDependencies": { "typescript": "^5.4.0" }\n}\n',
    "src/index.ts": 'import express from "express";\nimport { greet } from "./greet";\n\nexport const app = express();\n\n'
                    'app.get("/health", (_req, res) => res.json({ ok: true }));\napp.post("/greet/:name", (req, res) => res.send(greet(req.params.name)));\n\n'
                    "export function start(port: number): void {\n  // TODO: read the port from configuration instead of the caller\n  app.listen(port);\n}\n",
    "src/greet.ts": "export interface Greeting {\n  text: string;\n}\n\nexport function greet(name: string): string {\n  return `Hello, ${name}`;\n}\n",
    "src/util/format.ts": 'export const VERSION = "1.0.0";\n',
}


def as_files(spark, tree, repo="r"):
    return spark.createDataFrame([(repo, p, c) for p, c in tree.items()], "repo string, path string, content string")
