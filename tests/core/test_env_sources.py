"""Declarations of environment variables in every format, and the ranks of their files."""

import hashlib
from collections import Counter

import pytest

from coppice.operators import bridges
from coppice.sources import env_sources

FILES = {
    "docker-compose.yml": "version: '3'\nservices:\n  web:\n    image: x # ${NO}\n    environment:\n      A_ONE: plain # why\n      A_TWO: \"quo # ted\"\n      A_EMPTY:\n      A_REF: ${A_TWO}\n    env_file: .env\n  db:\n    environment:\n      - B_ONE=1=2\n      - B_BARE\n    env_file:\n    - a.env\n    - path: b.env\n      required: false\n    ports: [ \"80:80\", 81 ]\n",
    "k8s/all.yaml": """apiVersion: apps/v1
kind: Deployment
metadata: {name: x, labels: {a: b}}
spec:
  template:
    spec:
      initContainers:
        - name: init
          env: [ ]
      containers:
        - name: main
          env:
            - name: C_ONE
              value: "v"
            - name: C_SECRET
              valueFrom:
                secretKeyRef: {name: s, key: k}
            - name: C_EMPTY
          envFrom:
          - configMapRef:
              name: conf
---
kind: ConfigMap
data:
  D_ONE: |
    line one
    line: two
  D_TWO: x
---
kind: Secret
data:
  E_ONE: eA==
stringData:
  E_TWO: open
---
kind: SealedSecret
spec:
  encryptedData:
    F_ONE: AgB
---
kind: ExternalSecret
spec:
  data:
    - secretKey: G_ONE
      remoteRef: {key: a}
---
kind: Service
data:
  NOT: here
""",
    "chart/values.prod.yaml": "app:\n  env:\n    H_ONE: a\n    H_TWO: \"{{ .Values.x }}\"\nworkers:\n  - env:\n      - name: H_THREE\n        value: b\n",
    ".github/workflows/ci.yml": "env:\n  I_ONE: 1\njobs:\n  a:\n    env: {I_TWO: two}\n    steps:\n      - run: echo ${{ secrets.S_ONE }}\n        env:\n          I_THREE: ${{ secrets.S_TWO }}\n      - with:\n          env: {NOT: x}\n",
    ".env.production": "# J\nexport J_ONE='q # q'\nJ_TWO=a # c\nJ_EMPTY=\nnot a pair\n",
    ".env.example": "J_ONE=\n", ".envrc": "export K_ONE=1\n", "Dockerfile": "FROM x\nENV L_ONE=a L_TWO=\"b c\"\nENV L_THREE d e\nARG NOT=1\n",
    "package.json": '{"scripts": {"a": "M_ONE=1 M_TWO=$X node M_NOT=1", "b": "node"}}', "broken/package.json": "{", "enc/s.yaml": "x: ENC[AES256_GCM,data:abc]\nsops:\n  v: 1\n", "notes.md": "N=1",
}
WANT = [
    ("A_ONE", "docker_compose", "plain", "plain"), ("A_TWO", "docker_compose", "plain", "quo # ted"), ("A_REF", "docker_compose", "from", None), ("B_ONE", "docker_compose", "plain", "1=2"), ("B_BARE", "docker_compose", "empty", None),
    ("__env_file__", "docker_compose_env_file", "from", None), ("__env_file__", "docker_compose_env_file", "from", None), ("__env_file__", "docker_compose_env_file", "from", None),
    ("C_ONE", "k8s_deployment_env", "plain", "v"), ("C_SECRET", "k8s_deployment_env", "from", None), ("C_EMPTY", "k8s_deployment_env", "empty", None), ("__env_from__", "k8s_deployment_env_from", "from", None),
    ("D_ONE", "k8s_config_map", "plain", "line one\nline: two"), ("D_TWO", "k8s_config_map", "plain", "x"), ("E_ONE", "k8s_secret", "encrypted", None), ("E_TWO", "k8s_secret_string_data", "plain", "open"),
    ("F_ONE", "sealed_secret", "encrypted", None), ("G_ONE", "external_secret", "encrypted", None), ("H_ONE", "helm_values", "plain", "a"), ("H_TWO", "helm_values", "from", None), ("H_THREE", "helm_values", "plain", "b"),
    ("I_ONE", "github_actions_env", "plain", "1"), ("I_TWO", "github_actions_env", "plain", "two"), ("I_THREE", "github_actions_env", "from", None), ("S_ONE", "github_actions_secret", "from", None), ("S_TWO", "github_actions_secret", "from", None),
    ("J_ONE", "dotenv", "plain", "q # q"), ("J_TWO", "dotenv", "plain", "a"), ("J_EMPTY", "dotenv", "empty", None), ("J_ONE", "dotenv", "empty", None), ("K_ONE", "envrc", "plain", "1"),
    ("L_ONE", "dockerfile", "plain", "a"), ("L_TWO", "dockerfile", "plain", "b c"), ("L_THREE", "dockerfile", "plain", "d e"), ("M_ONE", "npm_script", "plain", "1"), ("M_TWO", "npm_script", "from", None), ("__sops__", "sops_file", "encrypted", None),
]


@pytest.fixture(scope="module")
def declared(spark):
    texts = spark.createDataFrame([*FILES.items(), ("gone.yaml", None)], "path string, content string")
    return env_sources.declarations(texts).cache()


def test_every_format(declared):
    digest = lambda v: None if v is None else hashlib.sha256(v.encode()).hexdigest()[:12]
    got = Counter((r["name"], r["source_kind"], r["presence"], r["value_hash"]) for r in declared.collect())
    assert got == Counter((n, k, p, digest(v)) for n, k, p, v in WANT)
    lines = {(r["name"], r["path"]): r["line"] for r in declared.collect()}
    assert lines["A_TWO", "docker-compose.yml"] == 7 and lines["J_TWO", ".env.production"] == 3 and lines["E_TWO", "k8s/all.yaml"] == 34
    assert {r["path"] for r in declared.where("template").collect()} == {".env.example"}


def test_templates_have_no_rank_and_names_refine(spark, declared):
    ages = declared.selectExpr("name", "source_kind", "path", "value_hash", "1 AS age_days")
    rows = [("X", "dotenv", p, None, 1) for p in (".env", ".env.production", ".env.staging", "a.env.local", ".env.test", ".env.sample")] + [("X", "odd", "z", None, 1)]
    ranks = {r["path"]: r["rank"] for r in bridges._ranked(spark.createDataFrame(rows, ages.schema)).collect()}
    assert ranks == {".env": 30, ".env.production": 38, ".env.staging": 34, "a.env.local": 25, ".env.test": 22, "z": 0}
    winners = {r["name"]: (r["winner"], r["sources"]) for r in bridges.env_truth(ages).collect()}
    assert winners["J_ONE"] == (".env.production", 1) and winners["D_TWO"][0] == "k8s/all.yaml"


def test_odd_files(spark):
    assert env_sources.declarations(spark.createDataFrame([], "path string, content string")).collect() == []
    assert env_sources.flatten("a:\n- 1\n- b: 2\n  c: [x, y]\n-\n  - z\nd: 'it''s'\n\te: 1\n: no\n- - -\n") [:5] == [(0, ["a", "[0]"], "1", 2), (0, ["a", "[1]", "b"], "2", 3), (0, ["a", "[1]", "c", "[0]"], "x", 4), (0, ["a", "[1]", "c", "[1]"], "y", 4), (0, ["a", "[2]", "[0]"], "z", 6)]
