"""A small project whose kinds of files the test tables lack: manifests, build, kernel and service files, traces.

The queries over it compare with the same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES: dict[str, str] = {
    "web/package.json": '{"name": "web", "dependencies": {"express": "^4.18.0", "@scope/tools": "1.0.0", "lodash": "4", "pg": "8", "left-pad": "1"}, "devDependencies": {"vitest": "1.0.0", "lodash": "4"}}',
    "web/broken/package.json": '{"dependencies": {',
    "web/src/app.ts": "import express from 'express';\nimport { a } from '@scope/tools/deep/a';\nimport { b } from './b';\nimport 'undeclared';\nconst q = require('pg-pool');\nexport async function main() { return import('chokidar'); }\n",
    "web/src/b.ts": "import { c } from './c';\nexport function b() { return c(); }\n",
    "web/src/c.ts": "import { d } from './d';\nexport function c() { return d(); }\n",
    "web/src/d.ts": "import { b } from './b';\nexport function d() { return b(); }\n",
    "api/requirements.txt": "# pinned\nfastapi==0.104.1\nuvicorn[standard]>=0.24\n-r other.txt\nrequests\n",
    "svc/go.mod": "module example/svc\n\ngo 1.22\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1\n\tgithub.com/redis/go-redis/v9 v9.0.0\n)\n",
    "svc1/go.mod": "module example/one\n\nrequire github.com/spf13/cobra v1.8.0\n",
    "core/Cargo.toml": '[package]\nname = "core"\n\n[dependencies]\nserde = "1.0"\ntokio = { version = "1", features = ["full"] }\n\n[dev-dependencies]\ncriterion = "0.5"\n',
    "fw/platformio.ini": "[env:esp32s3]\nplatform = espressif32\nboard = esp32-s3-devkitc-1\nframework = arduino\nbuild_flags = -DCORE_DEBUG_LEVEL=3 -O2\nlib_deps =\n    lvgl/lvgl@^8.3.0\n    bblanchon/ArduinoJson@^6.21.0\n    knolleary/PubSubClient\n\n[env:test]\nplatform = native\n",
    "fw/src/main.cpp": '#include <Arduino.h>\n#include <lvgl.h>\n#include <ArduinoJson.h>\n#include "audio.h"\n#include <esp_log.h>\n#include <TinyGPS/TinyGPS.h>\nvoid setup() { Serial.begin(9600); xTaskCreate(blink_task, "blink", 2048, NULL, 1, NULL); pinMode(2, 1); }\nvoid IRAM_ATTR on_edge(void) { GPIOA->CR = 1; }\nstatic int buf_STACK_SIZE = 4096;\n',
    "fw/lib/audio.h": "#define AUDIO_RATE 44100\nint audio_open(void);\n",
    "fw/src/irq.c": 'void TIM2_IRQHandler(void) { TIM2->DR = 0; }\nISR(TIMER1_OVF_vect) { }\nK_THREAD_DEFINE(worker, 1024, run, NULL, NULL, NULL, 5, 0, 0);\n#define HEAP_SIZE = 8192\nint rate(void) { return HAL_UART_Init(0) + i2s_read(); }\n',
    "fw/CMakeLists.txt": "cmake_minimum_required(VERSION 3.16)\nproject(firmware C)\nadd_executable(fw src/main.cpp src/irq.c)\ntarget_compile_options(fw PRIVATE -Wall -Wextra)\n",
    "kernel/drivers/foo/Kconfig": 'config FOO_DRIVER\n\ttristate "Foo support"\n\tdepends on OF\n\tselect REGMAP\n\tselect FOO_CORE\n\nconfig FOO_CORE\n\tbool\n\nconfig BAR\n\tbool "Bar"\n\tselect NOT_THERE\n',
    "kernel/.config": "CONFIG_FOO_DRIVER=m\nCONFIG_FOO_CORE=y\n# CONFIG_BAR is not set\n",
    "kernel/drivers/foo/Makefile": "obj-$(CONFIG_FOO_DRIVER) += foo.o\nobj-$(CONFIG_GHOST) += ghost.o\nfoo-objs := foo-main.o foo-irq.o\n",
    "kernel/board.dts": '/ {\n\tuart0: serial@1000 {\n\t\tcompatible = "acme,uart", "ns16550";\n\t\tstatus = "okay";\n\t};\n\tspi@2000 {\n\t\tcompatible = "acme,spi";\n\t\tstatus = "disabled";\n\t};\n\teth: ethernet@3000 {\n\t\tcompatible = "acme,eth";\n\t\tstatus = "okay";\n\t};\n};\n',
    "kernel/drivers/foo/foo-main.c": 'static const struct of_device_id m[] = { { .compatible = "acme,uart" }, {} };\nstatic struct platform_driver foo_driver = { .probe = foo_probe, .remove = foo_remove, .driver = { .name = "foo" } };\nmodule_param(debug_mode, int, 0);\nMODULE_LICENSE("GPL");\n',
    "kernel/drivers/foo/foo-spi.c": 'static const struct of_device_id s[] = { { .compatible = "acme,spi" }, { .compatible = "acme,gone" }, {} };\nstatic struct spi_driver bar_driver = { .probe = bar_probe, .driver = { .name = "bar" } };\nMODULE_LICENSE("GPL");\n',
    "image/foo.bb": 'SUMMARY = "Foo"\nLICENSE = "MIT"\nSRC_URI = "git://x"\nDEPENDS = "libfoo"\ninherit systemd cmake\n',
    "image/foo.service": "[Unit]\nAfter=network.target\n[Service]\nExecStart=/usr/bin/foo -x\n[Install]\nWantedBy=multi-user.target\n",
    "image/package/foo/Config.in": 'config BR2_PACKAGE_FOO\n\tbool "foo"\n\tselect BR2_PACKAGE_LIBFOO\n',
    "image/package/foo/foo.mk": "FOO_VERSION = 1.2\nFOO_SITE = https://example.org\nFOO_DEPENDENCIES = libfoo host-pkgconf\n$(eval $(generic-package))\n",
    "inc/api.h": "API_EXPORT int api_open(const char *name);\nAPI_EXPORT void api_close(int handle);\nint hidden(void);\n",
    "trace/trace.json": '{"id": "t1", "title": "Build", "version": "1", "steps": {"fetch": {"name": "fetch sources", "from_steps": []}, "parse": {"name": "parse code", "from_steps": ["fetch"]}, "index": {"name": "index", "from_steps": ["parse"]}, "lint": {"name": "lint", "from_steps": ["parse"]}, "report": {"name": "report", "from_steps": ["index", "lint"]}}}',
    "trace/runs/run_1/state.json": '{"name": "run_1", "started_at": "2024-01-01", "steps": {"fetch": {"status": {"kind": "done"}}, "parse": {"status": {"kind": "done"}}, "index": {"status": {"kind": "error", "message": "disk full"}}, "lint": {"status": {"kind": "done"}}, "report": {"status": {"kind": "waiting"}}}}',
    "trace/runs/run_2/state.json": '{"name": "run_2", "started_at": "2024-01-02", "steps": {"fetch": {"status": {"kind": "error", "message": "no network"}}, "parse": {"status": {"kind": "waiting"}}, "index": {}, "lint": {"status": {"kind": "running"}}, "report": {"status": {"kind": "waiting"}}}}',
    "trace/runs/run_3/state.json": "{broken",
    "trace/runs/run_2/replies/fetch.json": '{"step": "fetch", "author": "ann", "text": "Retry behind the proxy."}',
}


def files(spark: SparkSession, like: str | None = None) -> DataFrame:
    """(path, text) of the project, of paths that match the pattern ``like`` if given."""
    df = spark.createDataFrame(list(FILES.items()), "path string, text string")
    return df.where(df.path.rlike(like)) if like else df


def write(spark: SparkSession, folder: str) -> None:
    """The files as files under ``folder``, in whatever file system that names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path, text in FILES.items():
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{path}")
        out = p.getFileSystem(conf).create(p)
        out.write(bytearray(text.encode()))
        out.close()


def sql(body: str) -> str:
    """DuckDB SQL over the same rows, as ``fx(path, text)``."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    return "WITH RECURSIVE fx(path, text) AS (VALUES " + ", ".join(f"({q(p)}, {q(t)})" for p, t in FILES.items()) + ")" + (" " if body.lstrip().upper().startswith("SELECT") else ", ") + body
